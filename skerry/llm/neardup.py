"""Problem 3: records that are nearly the same, by banded HyperMinHash sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shingles import _mix, portions, shingle_sets
from skerry.runtime import small, staged

REPEATS, BUCKETS, MANTISSA = 3, 64, 10
REGISTERS = REPEATS * BUCKETS
ROWS = 4  # registers in a band
BANDS = REGISTERS // ROWS
REST = 58  # bits of a hash below the bucket's
EMPTY = 0xFFFF


def registers(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of registers a set: for ``REPEATS`` hash functions and ``BUCKETS`` buckets, of the least hash its count of leading zeros and the ``MANTISSA`` bits after the first one."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    out = np.empty((n, REPEATS, BUCKETS), np.uint16)
    for r in range(REPEATS):
        h = _mix(g ^ np.uint64(0xA0761D6478BD642F * (r + 1) & (2**64 - 1)))
        low = np.full(n * BUCKETS, 2**64 - 1, np.uint64)
        np.minimum.at(low, owner * BUCKETS + (h >> np.uint64(REST)).astype(np.int64), h & np.uint64(2**REST - 1))
        m, e = np.frexp(low.astype(np.float64))
        zeros = np.clip(REST - e, 0, 62).astype(np.uint16)
        reg = (zeros << np.uint16(MANTISSA)) | np.clip((2 * m - 1) * 2**MANTISSA, 0, 2**MANTISSA - 1).astype(np.uint16)
        out[:, r] = np.where(low == 2**64 - 1, EMPTY, reg).reshape(n, BUCKETS)
    return out.reshape(n, REGISTERS)


def filled_registers(reg: np.ndarray) -> np.ndarray:
    """Registers whose empty ones borrow from another bucket of the same hash function, chosen by position alone, so that equal sets still agree."""
    x = reg.reshape(-1, BUCKETS).copy()
    source = x.copy()
    full = source != EMPTY
    some = full.any(1)
    rng = np.random.default_rng(5)
    for step in range(40):
        to = rng.integers(BUCKETS, size=BUCKETS)
        row, col = np.nonzero((x == EMPTY) & some[:, None])
        if not len(row):
            break
        x[row, col] = source[row, to[col]]
    row, col = np.nonzero((x == EMPTY) & some[:, None])
    if len(row):
        x[row, col] = source[row, full.argmax(1)[row]]
    return x.reshape(reg.shape)


_SHUFFLED = np.random.default_rng(11).permutation(REGISTERS)


def band_keys(reg: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, of its registers, its number and the group that comparisons stay within."""
    x = filled_registers(reg)[:, _SHUFFLED].reshape(len(reg), BANDS, ROWS).astype(np.uint64)
    key = group.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        key = _mix(key * np.uint64(31) + x[:, :, j])
    return key.view(np.int64)


def chance_match(steps: int = 33) -> np.ndarray:
    """Chance that registers of two disjoint sets agree, by the binary logarithms of the elements a bucket of each (0 to 16 in halves).

    A register's cell is an interval of hash values; a set of ``n`` has its least hash in ``(a, b]``
    with chance ``(1 - a)^n - (1 - b)^n``. Sixteenths of an octave stand for their equal cells.
    """
    i, j = np.meshgrid(np.arange(1, REST), np.arange(16), indexing="ij")
    a = (1 + j / 16) * 2.0 ** -i
    b = a + 2.0 ** -i / 16
    n = 2.0 ** (np.arange(steps) / 2)[:, None, None]
    p = np.exp(n * np.log1p(-a)) - np.exp(n * np.log1p(-np.minimum(b, 1 - 1e-12)))
    p = np.maximum(p, 0).reshape(steps, -1)
    return p @ p.T / (2**MANTISSA / 16)


_CHANCE = chance_match()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity from two rows of registers and the sets' sizes, less expected chance matches; and its standard error at one half."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    same = ((a == b) & used).sum(1) / n
    i, j = (np.clip(np.round(2 * np.log2(np.maximum(x / BUCKETS, 1))), 0, len(_CHANCE) - 1).astype(int) for x in (na, nb))
    c = _CHANCE[i, j]
    return np.clip((same - c) / (1 - c), 0, 1), 0.5 / np.sqrt(n)


def sketches(records: DataFrame, key: str, group: str, text: str, n: int) -> DataFrame:
    """``(id, cls, copy, size, reg, keys)`` of each record with words: ``cls`` stands for its group and sequence of words, ``copy`` for its stored text, ``size`` counts shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            texts = big.column(2).to_pylist()
            for i, j in portions(texts):
                b = big.slice(i, j - i)
                g, at = shingle_sets(texts[i:j], n, distinct=False)
                size = np.diff(at)
                reg = registers(g, at)
                tick = b.column(1).to_numpy(zero_copy_only=False)
                inside = np.arange(len(g)) - np.repeat(at[:-1], size)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(g + inside.astype(np.uint64) * np.uint64(0x94D049BB133111EB)))])
                cls = _mix(total[at[1:]] - total[at[:-1]] + tick.astype(np.int64).view(np.uint64) * np.uint64(3)).view(np.int64)
                keys = band_keys(reg, tick)
                ok = pa.array(size > 0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                out = [b.column(0), pa.array(cls), b.column(3), pa.array(size, pa.int32()), pa.array([r.tobytes() for r in reg], pa.binary()), flat]
                yield pa.RecordBatch.from_arrays(out, ["id", "cls", "copy", "size", "reg", "keys"]).filter(ok)

    rows = records.filter(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("id"), F.xxhash64(group).alias("g"), F.col(text).alias("t"), F.xxhash64(text).alias("copy"))
    return rows.mapInArrow(sketch, "id string, cls long, copy long, size int, reg binary, keys array<long>")


def _shared(buckets: DataFrame) -> DataFrame:
    """The rows of ``(bkey, cls)`` whose bucket holds several classes, once each. Staged."""
    multi = staged(buckets.groupBy("bkey").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("bkey"))
    return staged(buckets.join(small(multi), "bkey").distinct())


def _rated(rows: DataFrame, block: int = 1024) -> DataFrame:
    """``(a, b, near, error)``, ``a < b``: all pairs of the classes of each bucket with the estimate of their similarity and its standard error.

    ``rows(bkey, n, cls, size, reg, keys)``. A bucket is split into blocks of about ``block`` classes
    and every two blocks are one group's work, so a bucket of any size is many tasks'. A pair comes
    out of the bucket of the first band its classes share, hence once; so a pair whose first band has
    a small bucket isn't among these.
    """

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "near": [], "error": []})
        if not len(left) or not len(right):
            return none
        bkey, p, q = key
        right = right.rename(columns=lambda c: c[1:])
        ca, cb = left["cls"].to_numpy(), right["cls"].to_numpy()
        ka, kb = np.stack(left["keys"].to_numpy()), np.stack(right["keys"].to_numpy())
        ra, rb = (np.frombuffer(b"".join(x["reg"]), np.uint16).reshape(len(x), REGISTERS) for x in (left, right))
        na, nb = left["size"].to_numpy(), right["size"].to_numpy()
        open_ = ca[:, None] < cb[None] if p == q else np.ones((len(ca), len(cb)), bool)
        for j in range(np.flatnonzero(ka[0] == bkey)[0]):
            open_ &= ka[:, j][:, None] != kb[:, j][None]
        i, j = np.nonzero(open_)
        if not len(i):
            return none
        step = 20_000
        rated = [estimate(ra[i[k : k + step]], rb[j[k : k + step]], na[i[k : k + step]], nb[j[k : k + step]]) for k in range(0, len(i), step)]
        near, error = (np.concatenate(x) for x in zip(*rated))
        return pd.DataFrame({"a": np.minimum(ca[i], cb[j]), "b": np.maximum(ca[i], cb[j]), "near": near, "error": error})

    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    kept = ["cls", "size", "reg", "keys"]
    left = rows.select("bkey", F.col("own").alias("p"), F.explode(F.sequence("own", blocks - 1)).alias("q"), *kept)
    right = rows.select("bkey", F.explode(F.sequence(F.lit(0), "own")).alias("p"), F.col("own").alias("q"), *kept)
    # Other names on the right, since both come from the same columns.
    right = right.select(*(F.col(c).alias(f"r{c}") for c in right.columns))
    return left.groupBy("bkey", "p", "q").cogroup(right.groupBy("rbkey", "rp", "rq")).applyInPandas(compare, "a long, b long, near double, error double")


def candidates(s: DataFrame, most: int = 128) -> tuple[DataFrame, DataFrame | None]:
    """``(a, b)``, ``a < b``: classes that share a band; and, of buckets of more than ``most`` classes, ``(a, b, near, error)``, if there are such.

    Every pair of every bucket is a candidate. Those of large buckets are estimated where they are
    formed, block by block, so that only the likely ones need be written.
    """
    sketch = s.select("cls", "keys")
    m = _shared(sketch.select("cls", F.explode("keys").alias("bkey")))
    sizes = m.groupBy("bkey").agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > most)

    def pairs(x: DataFrame) -> DataFrame:
        a, b = x.select("bkey", F.col("cls").alias("a")), x.select("bkey", F.col("cls").alias("b"))
        return a.join(b, "bkey").filter("a < b").select("a", "b")

    if hot.isEmpty():
        return pairs(m).distinct(), None
    hot = staged(hot)
    one = s.select("cls", "size", "reg", "keys").dropDuplicates(["cls"])
    return pairs(m.join(hot, "bkey", "left_anti")).distinct(), _rated(m.join(hot, "bkey").join(one, "cls"))


def links(records: DataFrame, key: str, group: str, text: str, n: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(a, b, similarity)`` between classes at ``least`` or more, and ``(id, cls, copy)`` of all records with words.

    Records of one class have the same words in the same order; those of one ``copy`` also the same text. Sketches are banded into candidates;
    a candidate whose corrected estimate lies more than four and a half standard errors under
    ``least`` is dropped; the rest are verified on the shingles of the texts themselves.
    """
    s = staged(sketches(records, key, group, text, n))
    one = s.select("cls", "reg", "size").dropDuplicates(["cls"])
    pairs, rated = candidates(s)

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(c), np.uint16).reshape(len(c), REGISTERS) for c in (a, b))
        j, e = estimate(x, y, na.to_numpy(), nb.to_numpy())
        return pd.Series(j >= least - 4.5 * e)

    left, right = (one.select(F.col("cls").alias(c), F.col("reg").alias(f"r{c}"), F.col("size").alias(f"n{c}")) for c in "ab")
    pairs = pairs.join(left, "a").join(right, "b").filter(likely("ra", "rb", "na", "nb")).select("a", "b")
    if rated is not None:
        pairs = pairs.union(rated.filter(F.col("near") >= least - 4.5 * F.col("error")).select("a", "b")).distinct()
    pairs = staged(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    ids = s.select("id", "cls").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in portions(texts):
                g, at = shingle_sets(texts[i:j], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(g.view(np.int64)))], ["cls", "set"])

    rows = records.filter(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))
    texts = rows.join(small(staged(ids)), "id").select("cls", "t")
    exact = staged(texts.mapInArrow(sets, "cls long, set array<long>").dropDuplicates(["cls"]))
    both = F.size(F.array_intersect("sa", "sb"))
    j = both / (F.size("sa") + F.size("sb") - both)
    left, right = (exact.select(F.col("cls").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    found = pairs.join(left, "a").join(right, "b").withColumn("similarity", j).filter(F.col("similarity") >= least)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity")), s.select("id", "cls", "copy").distinct()


def close_pairs(records: DataFrame, key: str = "chunk_id", group: str = "ticker", text: str = "text", n: int = 2, least: float = 0.55, most: int = 64) -> DataFrame:
    """``(<key>_a, <key>_b)``: different records of one ``group`` whose sets of ``n`` adjacent words have a Jaccard similarity of at least ``least``.

    Records with the same words in the same order form a class. Links are found between classes; the
    members of classes are written out as pairs, of one another and across links, in blocks of
    about a thousand members. Only of more than ``most`` records with the very same text the least
    stands for all and is paired with each other one: so copies, however many, give as many rows,
    and no pair of different texts is lost but for copies beyond the least.

    Null keys, groups and texts and texts without words pair with nothing; repeated rows count once;
    extra columns are ignored; an empty table gives an empty result.
    """
    found, members = links(records, key, group, text, n, least)
    size = members.groupBy("cls", "copy").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first")).filter(F.col("n") > most)
    m = staged(members.join(size, ["cls", "copy"], "left"))
    shown = m.filter(F.col("n").isNull() | (F.col("id") == F.col("first"))).select("id", "cls").distinct()
    # Blocks of a class, so that the members of a large one meet in many tasks.
    blocks = shown.groupBy("cls").agg(F.ceil(F.count("*") / 1024).cast("int").alias("k"), F.count("*").alias("members"))
    shown = staged(shown.join(blocks, "cls").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    several = shown.filter("members > 1")
    a = several.select("cls", F.col("own").alias("p"), every.alias("q"), F.col("id").alias("ia"))
    b = several.select("cls", every.alias("p"), F.col("own").alias("q"), F.col("id").alias("ib"))
    copies = a.join(b, ["cls", "p", "q"]).filter("ia < ib").select("ia", "ib")
    a, b = (shown.select(F.col("id").alias(f"i{c}"), F.col("cls").alias(c), F.col("own").alias(f"p{c}")) for c in "ab")
    ka, kb = (blocks.select(F.col("cls").alias(c), F.col("k").alias(f"k{c}")) for c in "ab")
    met = found.select("a", "b").join(ka, "a").join(kb, "b")
    met = met.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    across = met.join(a, ["a", "pa"]).join(b, ["b", "pb"]).select("ia", "ib")
    star = m.filter(F.col("n").isNotNull() & (F.col("id") > F.col("first"))).select(F.col("first").alias("ia"), F.col("id").alias("ib"))
    out = across.union(copies).union(star).filter("ia <> ib")
    return out.select(F.least("ia", "ib").alias(f"{key}_a"), F.greatest("ia", "ib").alias(f"{key}_b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(cls, root)``: the least class each class of ``(a, b)`` is connected with.

    Alternates large and small stars: every class links its larger neighbours, then its smaller
    ones, to the least of its neighbours and itself, until nothing changes. Each round is written.
    """
    e = staged(edges.select("a", "b").filter("a <> b").distinct())
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v"), F.col("m"))
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("v", "m").union(low.select("u", "m")).filter("v <> m").toDF("b", "a").select("a", "b").distinct()
        new = staged(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("b").alias("cls"), F.col("a").alias("root"))


def groups(records: DataFrame, key: str = "chunk_id", group: str = "ticker", text: str = "text", n: int = 2, least: float = 0.55) -> DataFrame:
    """``(<key>, group_id, n_links, n_copies)``: one row a record with words: its group of near duplicates, its links to different texts, and the records with its very words.

    ``group_id`` is the least ``<key>`` of the group; a record like no other is a group of one.
    """
    found, members = links(records, key, group, text, n, least)
    found, members = staged(found), staged(members.select("id", "cls").distinct())
    roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("cls").agg(F.count("*").alias("n_copies"), F.min("id").alias("first"))
    classes = classes.join(roots, "cls", "left").join(degree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    name = classes.groupBy("root").agg(F.min("first").alias("group_id"))
    classes = classes.join(name, "root").select("cls", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return members.join(classes, "cls").select(F.col("id").alias(key), "group_id", "n_links", "n_copies")
