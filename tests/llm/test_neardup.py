import random
import re
from itertools import combinations

import numpy as np

from skerry.llm import neardup, shingles

SCHEMA = "chunk_id string, ticker string, text string, cls long, a int, keys string"


def grams(text, n=2):
    w = re.findall("[a-z]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b, n=2):
    a, b = grams(a, n), grams(b, n)
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(data, n=2, least=0.55):
    by = {}
    for c, t, x in {r[:3] for r in data if None not in r[:3]}:
        by.setdefault(t, []).append((c, x))
    return sorted(tuple(sorted((a, b))) for L in by.values() for (a, x), (b, y) in combinations(sorted(L), 2) if a != b and jaccard(x, y, n) >= least)


def corpus(seed=0, docs=60, words=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(800)]
    out = []
    for i in range(docs):
        base = r.choices(vocabulary, k=words)
        for v in range(r.choice([1, 1, 2, 3])):
            w = list(base)
            for _ in range(0 if v == 0 else r.choice([2, 6, 12, 25])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((f"{i:03d}#{v}", r.choice("AB") if i % 7 == 0 else "A", " ".join(w)))
    return out


def extra(rows):
    return [(*r, 1, 2, "x") for r in rows]


def test_shingles_are_the_sets_of_words():
    texts = ["", "one", "a b a b", "Ａ É1x y z", "K-ite the THE the", "ab" * 400 + " c", "\ud800 x y"]
    g, at = shingles.shingle_sets(texts, 2)
    assert [int(b - a) for a, b in zip(at, at[1:])] == [len(grams(t)) for t in texts]
    flat, ends = shingles.shingle_sets(texts, 2, distinct=False)
    assert all(set(flat[a:b]) == set(g[c:d]) for a, b, c, d in zip(ends, ends[1:], at, at[1:]))


def test_portions_cover_all():
    texts = ["x" * n for n in (5, 0, 50, 3, 3, 200, 1)]
    got = list(shingles.portions(texts, 3, 60))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(texts)))


def test_estimate_is_close():
    r = random.Random(4)
    for share in (0.2, 0.55, 0.9):
        a = [r.getrandbits(64) for _ in range(1500)]
        k = int(len(a) * 2 * share / (1 + share))
        b = a[:k] + [r.getrandbits(64) for _ in range(len(a) - k)]
        g = np.array(a + b, np.uint64)
        reg = neardup.registers(g, np.array([0, len(a), len(a) + len(b)]))
        j, e = neardup.estimate(reg[:1], reg[1:], np.array([len(a)]), np.array([len(b)]))
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(j[0] - true) < 4 * e[0]


def test_pairs_like_brute_force(spark, rows):
    data = corpus()
    data += [data[3], ("zz#0", "A", data[5][2]), ("zz#1", "A", data[5][2]), ("n1", None, data[5][2]), ("n2", "A", None), ("n3", "A", ""), ("n4", "A", "12 34"), ("w1", "A", "solo"), ("w2", "A", "Solo!"), (None, "A", data[5][2])]
    data += [("long1", "B", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(30_000))), ("long2", "B", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(29_000)))]
    got = rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA)))
    assert got == brute(data)
    assert len(got) > 20


def test_large_buckets_are_split(spark, rows, monkeypatch):
    """With a bucket bound of 4, hot buckets are cut by second bands; what is lost stays little, and groups stay whole."""
    real = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda s: real(s, most=4))
    r = random.Random(9)
    base = r.choices(["".join(r.choices("abcdefgh", k=5)) for _ in range(400)], k=200)
    data = [(f"{i:02d}", "A", " ".join(w if r.random() > 0.02 else "edit" + "x" * r.randrange(9) for w in base)) for i in range(40)]
    got, true = set(rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA)))), set(brute(data))
    assert got <= true and len(true) == 780
    g = neardup.groups(spark.createDataFrame(extra(data), SCHEMA)).collect()
    assert {x["group_id"] for x in g} == {"00"}


def test_many_copies_make_few_rows(spark, rows):
    data = [(f"c{i:03d}", "A", "the same words in every copy of this text") for i in range(200)] + [("d", "A", "the same words in every copy of this text too")]
    got = rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA), most=8))
    assert got == [("c000", f"c{i:03d}") for i in range(1, 200)] + [("c000", "d")]


def test_groups(spark):
    data = corpus(2, 25) + [("copy", "A", corpus(2, 25)[0][2])]
    links = brute(data)
    parent = {c: c for c, _, _ in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["chunk_id"]: r["group_id"] for r in neardup.groups(spark.createDataFrame(extra(data), SCHEMA)).collect()}
    assert got == {c: root(c) for c, _, _ in data}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["cls"]: r["root"] for r in neardup.components(edges).collect()}
    assert {got[i] for i in range(1, 301)} == {0} and got[1001] == 1000


def test_five_words_at_four_fifths(spark, rows):
    data = corpus(6, 30, 200)
    got = rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA), n=5, least=0.8))
    assert got == brute(data, 5, 0.8)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.close_pairs(df).count() == 0 and neardup.groups(df).count() == 0


def test_large_buckets_lose_nothing(spark, rows, monkeypatch):
    """With a bucket bound of 4 nearly all buckets are hot; every pair still comes out, in blocks of 16 too."""
    real, rated = neardup.candidates, neardup._rated
    monkeypatch.setattr(neardup, "candidates", lambda s: real(s, most=4))
    monkeypatch.setattr(neardup, "_rated", lambda x: rated(x, block=16))
    r = random.Random(9)
    base = r.choices(["".join(r.choices("abcdefgh", k=5)) for _ in range(400)], k=200)
    data = [(f"{i:02d}", "A", " ".join(w if r.random() > 0.02 else "edit" + "x" * r.randrange(9) for w in base)) for i in range(40)]
    df = spark.createDataFrame(extra(data), SCHEMA)
    true = brute(data)
    assert rows(neardup.close_pairs(df)) == true and len(true) == 780


def test_one_shared_hot_band_makes_a_candidate(spark):
    """Six classes that share their first band only, under a bound of 4."""
    g = np.arange(6 * 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    reg = neardup.registers(g, np.arange(0, 1201, 200))
    s = [(c, 200, bytearray(reg[c].tobytes()), [-1] + [c * 100 + j for j in range(1, neardup.BANDS)]) for c in range(6)]
    found, rated = neardup.candidates(spark.createDataFrame(s, "cls long, size int, reg binary, keys array<long>"), most=4)
    assert found.count() == 0
    assert sorted((r["a"], r["b"]) for r in rated.collect()) == list(combinations(range(6), 2))


def test_texts_of_a_class_that_differ_are_all_paired(spark, rows):
    """A hundred notices that differ in their figures only, and one that links to them; the copies of one text are collapsed."""
    data = [(f"v{i:03d}", "A", f"revenue of {i} dollars in the year {1900 + i} was as shown") for i in range(100)] + [("w", "A", "revenue of x dollars in the year was as shown")]
    assert rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA))) == brute(data)
    data += [(f"z{i}", "A", "Revenue of 7 dollars in the year 1 was as shown") for i in range(5)]
    true = [p for p in brute(data) if not set(p) & {f"z{i}" for i in range(1, 5)}] + [("z0", f"z{i}") for i in range(1, 5)]
    assert rows(neardup.close_pairs(spark.createDataFrame(extra(data), SCHEMA), most=4)) == sorted(true)
