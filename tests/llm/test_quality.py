import random

import numpy as np
import pytest

from skerry.llm import quality

DOCS = "doc_id long, text string, x string, text_class string, chance string"
LABELS = "doc_id long, text_class string, x int"
WORDS = "revenue market supply plant labour policy demand season vessel harbour lender margin office tariff review copper timber energy".split()


def prose(r):
    return "\n".join(" ".join(f"The {r.choice(WORDS)} of our {r.choice(WORDS)} and the {r.choice(WORDS)} will be {r.choice(WORDS)} in {r.choice(WORDS)}." for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(2, 6)))


def table(r):
    return "\n".join(f"{r.choice(WORDS).title()} {r.choice(WORDS)} | {r.randrange(10**6):,} | {r.randrange(10**5):,}" for _ in range(r.randrange(6, 25)))


def listing(r):
    return "\n".join(f"- {r.choice(WORDS).title()} {r.choice(WORDS)}" for _ in range(r.randrange(6, 25)))


def junk(r):
    return "".join(r.choice("#@!$%^&*<>~|") for _ in range(r.randrange(100, 600))) if r.random() < 0.5 else f"their {r.choice(WORDS)} / " * r.randrange(20, 60)


KINDS = {"prose": prose, "list": listing, "table": table, "junk": junk}


def made(n, seed):
    r = random.Random(seed)
    return [(i, KINDS[k](r), k) for i, k in enumerate(r.choices(list(KINDS), (6, 2, 2, 1), k=n))]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t, *_ in data], DOCS)


def test_held_out_accuracy(spark):
    data = made(1200, 1)
    labels = spark.createDataFrame([(i, k, 1) for i, _, k in data if i % 4 == 0] + [(1, None, 1), (None, "prose", 1), (2, "else", 1), (99999, "junk", 1)], LABELS)
    got = {r["doc_id"]: r["text_class"] for r in quality.classified(frame(spark, data), labels).collect()}
    held = [(k, got[i]) for i, _, k in data if i % 4]
    assert sum(a == b for a, b in held) / len(held) > 0.98


def test_statistics_of_a_text():
    s = dict(zip(quality.STATS, quality.statistics(["The cost of it was 12 %.\nAnd so on, he said.\n\n- x y z"])[0]))
    assert s["sentence_lines"] == pytest.approx(2 / 3) and s["bullet_lines"] == pytest.approx(1 / 3) and s["short_lines"] == pytest.approx(2 / 3)
    assert s["n_words"] == pytest.approx(np.log1p(13)) and s["number_words"] == pytest.approx(1 / 16) and s["mean_word"] == pytest.approx(30 / 13)


def test_statistics_do_not_depend_on_neighbours():
    r = random.Random(3)
    texts = [t for _, t, _ in made(60, 4)] + ["a", ".", "株式会社", "Ã©Ã© â€™ x", "\ud800x", " \n x", "w" * 1000, "1"]
    r.shuffle(texts)
    together = quality.statistics(texts)
    assert np.isfinite(together).all()
    for t, row in zip(texts, together):
        assert np.allclose(quality.statistics([t])[0], row)


def test_odd_texts(spark):
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "  "), (5, "x"), (5, "x"), (6, "word " * 200_000), (7, "|;|;")]
    df = frame(spark, data)
    assert {r["doc_id"] for r in quality.text_statistics(df).collect()} == {5, 6, 7}
    no_labels = spark.createDataFrame([], LABELS)
    assert quality.classified(df, no_labels).count() == 3
    assert quality.classified(frame(spark, []), no_labels).count() == 0


def test_all_the_same(spark):
    df = frame(spark, [(i, "the same text.") for i in range(50)])
    labels = spark.createDataFrame([(1, "prose", 1), (1, "prose", 1)], LABELS)
    assert {r["text_class"] for r in quality.classified(df, labels).collect()} == {"prose"}
