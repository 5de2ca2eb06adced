import bisect
import random

import numpy as np
import pytest

from skerry.llm import mixing, packing, tokens

SIZES = "doc_id long, n_tokens int, piece_no int, size int, container_id int"


def frame(spark, sizes):
    return spark.createDataFrame([(i, n, 1, 2, 3) for i, n in enumerate(sizes)], SIZES)


def check(spark, sizes, capacity=2048):
    got = packing.pack(frame(spark, sizes), capacity=capacity).toPandas()
    assert got.groupby("container_id")["size"].sum().max() <= capacity
    assert not got.duplicated(["doc_id", "piece_no"]).any()
    for i, n in enumerate(sizes):
        mine = got[got["doc_id"] == i].sort_values("piece_no")
        assert mine["size"].sum() == max(0, n or 0) and list(mine["first"]) == list(range(0, max(0, n or 0), capacity))
    return got


def best_fit(sizes, capacity=2048):
    """Containers that best fit, largest first, needs."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - s)
    return len(rooms)


def test_containers_are_nearly_full(spark):
    r = random.Random(1)
    sizes = [min(2048, int(r.lognormvariate(5.3, 0.9)) + 1) for _ in range(3000)]
    got = check(spark, sizes)
    assert got["container_id"].nunique() <= best_fit(sizes) and sum(sizes) / (2048 * got["container_id"].nunique()) > 0.995
    assert sorted(got["container_id"].unique()) == list(range(got["container_id"].nunique()))


def test_hard_sizes(spark):
    """Three sizes that only fill a container together, in unequal numbers."""
    got = check(spark, [1024] * 200 + [700] * 200 + [324] * 200 + [2048] * 50 + [1] * 10)
    assert got["container_id"].nunique() <= 253


def test_one_length_holds_a_third(spark):
    r = random.Random(2)
    sizes = [137] * 1500 + [r.randrange(1, 2048) for _ in range(3000)]
    got = check(spark, sizes)
    assert got["container_id"].nunique() <= 1.005 * best_fit(sizes)


def test_odd_sizes(spark):
    check(spark, [0, -3, None, 2048, 2049, 5000, 1, 4096])
    assert packing.pack(frame(spark, [])).count() == 0


def test_every_item_of_a_histogram_is_placed():
    r = np.random.default_rng(3)
    for n in (1, 5, 200):
        counts = r.integers(0, 50, size=101) * (r.random(101) < n / 100)
        counts[0] = 0
        plan = packing.configurations(np.arange(101), counts, 100)
        assert (sum((a * m for a, m in plan), np.zeros(101, int)) == counts).all()
        assert all(a @ np.arange(101) <= 100 for a, _ in plan)


def test_token_counts(spark):
    """As encoding whole texts gives them, very long ones too."""
    texts = ["Hello world", "", None, "x" * 250_000, "<|endoftext|> 株式 �", "word " * 60_000, " ", "\n", "  a\n b\n\nc ", "a\tb\r\n  c"]
    sp = tokens.processor(open(tokens.VOCABULARY, "rb").read())
    assert tokens.separable(sp)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select(tokens.token_count("t")).collect()]
    assert got == [len(sp.encode(t)) if t else 0 for t in texts]


def test_units_add_up(monkeypatch):
    model = open(tokens.VOCABULARY, "rb").read()
    sp, r = tokens.processor(model), random.Random(4)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    count = tokens.counter(model)
    parts = [" ", "\n", "a", "the", "foo ", "  ", "é", "\t", ".", "中", " 1", "\r\n", "x" * 150, "▁", "\u00a0"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        assert count(t) == len(sp.encode(t)), repr(t)


def test_split_items_come_out_of_the_packing(spark, rows):
    got = packing.pack(frame(spark, [5, 2048, 2049, 4096, 100, 2000, None]))
    assert rows(packing.split_items(got)) == [(2,), (3,)]


def test_the_program_fills_most_containers():
    r = np.random.default_rng(6)
    counts = np.bincount(np.clip(r.lognormal(5.3, 0.9, 20_000).astype(int), 1, 2048), minlength=2049)
    assert packing.placed_by_program(np.arange(2049), counts, 2048) > 0.5


DOCS = "doc_id long, source string, n_tokens long, quality double, bin int, key string"


def docs(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], DOCS)


def made(seed=0):
    r = random.Random(seed)
    return [(i, "big" if i < 2000 else "mid" if i < 2600 else "tiny", r.randrange(1, 400), r.choice([0.2, 1.0, 1.4])) for i in range(2650)]


def test_shares_and_mixture(spark):
    data = made()
    total = sum(r[2] for r in data)
    size = {s: sum(r[2] for r in data if r[1] == s) for s in ("big", "mid", "tiny")}
    targets = spark.createDataFrame([("big", 0.3, 2), ("big", 0.3, 2), ("mid", 0.4, 4), ("tiny", 0.2, 3), ("gone", 0.1, 5), ("none", 0.0, 1), (None, 0.1, 1), ("void", None, None)], "source string, weight double, max_repeats int")
    d = docs(spark, data)
    plan = mixing.shares(d, targets)
    p = {r["source"]: r for r in plan.collect()}
    assert set(p) == {"big", "mid", "tiny", "gone", "none", "void"}
    assert {s for s, r in p.items() if r["capped"]} == {"tiny", "gone"}
    mix = mixing.mixture(d, plan).toPandas()
    assert not mix["doc_id"].duplicated().any()
    used = (mix["n_tokens"] * mix["copies"]).groupby(mix["source"]).sum()
    assert used["tiny"] == 3 * size["tiny"]
    for s, w in (("big", 0.3), ("mid", 0.4)):
        assert w * total - 400 <= used[s] <= w * total
    for s in used.index:
        assert mix[mix["source"] == s]["copies"].max() <= p[s]["max_repeats"]
    epochs = int(0.4 * total // size["mid"])
    assert set(mix[mix["source"] == "mid"]["copies"]) <= {epochs, epochs + 1} and len(mix[mix["source"] == "mid"]) == 600
    got = {r["source"]: r for r in mixing.reached(mixing.mixture(d, plan), plan).collect()}
    assert sum(r["share"] for r in got.values()) == pytest.approx(1) and got["gone"]["used"] == 0


def test_mixture_is_the_sorted_prefix(spark):
    """The same as sorting each source by its keys and taking the prefix within the rest."""
    data = made(5)
    d = docs(spark, data)
    plan = mixing.shares(d, spark.createDataFrame([("big", 0.35, 1), ("mid", 0.1, 1)], "source string, weight double, max_repeats int"))
    rest = {r["source"]: r["rest"] for r in plan.collect()}
    from pyspark.sql import functions as F

    u = (F.pmod(F.xxhash64(F.lit(42), F.col("doc_id")), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    want = set()
    for s in rest:
        run = 0
        for r in d.filter(F.col("source") == s).withColumn("k", -F.ln(u) / F.col("quality")).orderBy("k", "doc_id").collect():
            run += r["n_tokens"]
            if run > rest[s]:
                break
            want.add(r["doc_id"])
    got = {r["doc_id"] for r in mixing.mixture(d, plan).collect()}
    assert got == want


def test_better_documents_are_drawn_more_often(spark):
    data = [(i, "s", 10, 1.5 if i % 2 else 0.3) for i in range(4000)]
    d = docs(spark, data)
    mix = mixing.mixture(d, mixing.shares(d, spark.createDataFrame([("s", 0.3, 1)], "source string, weight double, max_repeats int")))
    odd = mix.filter("doc_id % 2 = 1").count()
    assert odd / mix.count() > 0.7


def test_nothing_to_mix(spark):
    d = docs(spark, [])
    plan = mixing.shares(d, spark.createDataFrame([("s", 0.3, 1)], "source string, weight double, max_repeats int"))
    assert [(r["capped"], r["tokens"]) for r in plan.collect()] == [(False, 0)]
    assert mixing.mixture(d, plan).count() == 0
    plan = mixing.shares(docs(spark, made()), spark.createDataFrame([], "source string, weight double, max_repeats int"))
    assert plan.count() == 0


def test_from_texts(spark):
    t = spark.createDataFrame([(1, "a b c d e f", "s", "x"), (1, "a b c d e f", "s", "x"), (2, None, "s", "y"), (3, "", "s", "z"), (4, "\x00\x01", None, "w")], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r for r in mixing.sized(t).collect()}
    assert got[1]["n_tokens"] == 6 and got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and len(got) == 4
