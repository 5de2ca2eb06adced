import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import chunking


def prose(n, seed=0):
    r = random.Random(seed)
    return "".join(" ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(r.randrange(4, 12))) + r.choice([". ", ".\n", "? "]) for _ in range(n))


def check(text, limit=2400, overlap=200, least=600):
    got = chunking.cut(text, limit, overlap, least)
    assert got[0][0] == got[0][2] == 0 and got[-1][1] == len(text)
    for (s, e, b), (s2, e2, b2) in zip(got, got[1:]):
        assert b2 == e and max(s, b2 - overlap) <= s2 <= b2
    assert all(e - s <= limit for s, e, _ in got)
    assert "".join(text[b:e] for _, e, b in got) == text
    return got


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n|é́‍株"), max_size=3000))
def test_bodies_tile_the_text(text):
    check(text, 100, 20, 30)


def test_cuts_fall_on_natural_boundaries():
    text = prose(400)
    for _, e, _ in check(text)[:-1]:
        assert text[e - 1] in " \n" and text[e - 2] in ".?"
    table = "\n".join(f"Row {i} | {i * 7} | {i * 13}" for i in range(600))
    assert all(table[e - 1] == "\n" for _, e, _ in check(table)[:-1])


def test_without_boundaries_it_still_cuts():
    assert len(check("x" * 10_000)) >= 5
    check("e" + "́" * 5000)


def test_an_edit_alters_only_neighbours():
    text = prose(900, 3)
    edited = text[:5000] + "A few words put in here. " + text[5000:]
    a = [text[b:e] for _, e, b in check(text)]
    b = [edited[b:e] for _, e, b in check(edited)]
    assert len(set(a) & set(b)) >= len(a) - 6
    assert a[-3:] == b[-3:] and a[:2] == b[:2]


def test_very_long_text():
    text = prose(60_000, 5)
    assert len(text) > 2_000_000
    check(text)


SCHEMA = "chunk_id string, item string, text string, n_chars int, p string, piece_no int"


def test_pieces(spark, rows):
    long = prose(200)
    data = [("a", "1A", long, 3, None, 9), ("a", "1A", long, 3, None, 9), ("b", None, "short", 99_999, "x", 1), ("c", "2", None, None, None, None), ("d", None, "", 0, None, None), ("e", None, "y" * 2400, 1, None, None), ("f", None, "y" * 2401, 1, None, None)]
    got = chunking.pieces(spark.createDataFrame(data, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {"a", "b", "d", "e", "f"}
    assert "".join(r["text"][r["body_start"] - r["start"] :] for r in sorted(by["a"], key=lambda r: r["piece_no"])) == long
    assert all(len(r["text"]) <= 2400 and r["item"] == "1A" for r in by["a"])
    assert [len(by[k]) for k in "bdef"] == [1, 1, 1, 2]
    assert chunking.pieces(spark.createDataFrame([], SCHEMA)).count() == 0
