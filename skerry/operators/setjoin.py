"""Pairs of similar sets of words within groups: blocks of sets meet in one task each, and only similar pairs come out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.runtime import small

#: A group of more sets than this is cut, into up to ``FEW`` blocks for the sake of all cores, and into more where one would hold over ``MOST`` sets.
BLOCK, FEW, MOST = 8192, 5, 65_536
#: Numbers and words that one step of a task may hold.
CELLS, WORDS = 2**21, 2**21


class Sets:
    """Sets of hashed words: those of row ``i`` are the ``n[i]`` of ``words`` from ``start[i]`` on."""

    def __init__(self, column: pa.ListArray):
        self.words = column.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF
        self.n = column.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.n) - self.n

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Where the words of ``rows`` stand, one row's after the other's."""
        k = self.n[rows]
        return np.repeat(self.start[rows] - np.cumsum(k) + k, k) + np.arange(k.sum())

    def counts(self, rows: np.ndarray, d: int) -> np.ndarray:
        """How many of each row's words fall into each of ``d`` cells."""
        cells = np.repeat(np.arange(len(rows)) * d, self.n[rows]) + self.words[self.positions(rows)] % d
        return np.bincount(cells, minlength=len(rows) * d).reshape(len(rows), d).astype(np.float32)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words rows ``i`` and ``j`` share, pair by pair: those that stand side by side once both are sorted."""
        rows = np.concatenate([i, j])
        both = np.sort(np.repeat(np.tile(np.arange(len(i)), 2), self.n[rows]) << 32 | self.words[self.positions(rows)])
        return np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(i))

    def similar(self, left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of ``left`` and one of ``right``, or of two rows of ``left``, of a Jaccard similarity of at least ``least``.

        Rows go by size, so that only sizes that can be similar meet. Words are counted in four times as
        many cells as a set has words. The product of two rows of counts is no less than what they
        share, so one matrix product leaves out pairs that stay below the bound; the few others are
        counted word by word. Two words of one hash only add to what is shared: no pair is missed.
        """
        share, n, same = least / (1 + least), self.n, right is None
        left = left[np.argsort(n[left], kind="stable")]
        right = left if same else right[np.argsort(n[right], kind="stable")]
        size = n[right]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        a = 0
        while a < len(left):
            d = int(min(16_384, max(64, 4 * n[left[min(a + 512, len(left) - 1)]])))
            e = min(len(left), a + max(1, min(2048, CELLS // d)))
            x = left[a:e]
            lo, hi = np.searchsorted(size, n[x[0]] * least - 1e-6), np.searchsorted(size, n[x[-1]] / least + 1e-6, "right")
            u = np.hstack([self.counts(x, d), n[x, None], np.ones((len(x), 1))], dtype=np.float32, casting="same_kind")
            step = max(1, min(4096, CELLS // d))
            for b in range(max(lo, a) if same else lo, hi, step):
                y = right[b : min(b + step, hi)]
                v = np.hstack([self.counts(y, d), np.full((len(y), 1), -share), -share * n[y, None]], dtype=np.float32, casting="same_kind")
                i, j = np.nonzero(u @ v.T >= -0.01 - 1e-4 * n[x[-1]])
                if same:
                    i, j = i[a + i < b + j], j[a + i < b + j]
                i, j = x[i], y[j]
                most = max(1, WORDS // int(n[x[-1]] + n[y[-1]]))
                for c in range(0, len(i), most):
                    p, q = i[c : c + most], j[c : c + most]
                    keep = self.shared(p, q) >= share * (n[p] + n[q]) - 1e-3
                    found.append((p[keep], q[keep]))
            a = e
        return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def similar_pairs(sets: DataFrame, rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """``(group, a, ka, b, kb)``, ``a < b``: which of ``sets(group, id, key, h)`` of a group are similar, by their hashed words ``h``.

    All similar pairs are there, and in rare cases a pair that only hashes make similar. ``rows(group)``
    says how many sets a group has at most. Small groups are put together in portions; a large one is
    cut into blocks by key, and each two blocks are one job, so that what is shuffled are sets, never pairs.
    """
    counts = rows.groupBy("group").agg(F.count("*").alias("n"))
    m = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(FEW)), F.ceil(F.col("n") / MOST)).cast("int")
    large = small(counts.filter(F.col("n") > block).select(F.col("group").alias("_g"), m.alias("m")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    portions = max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * block)))
    s = sets.join(large, sets["group"] == large["_g"], "left").withColumn("k", F.pmod(F.xxhash64("key"), F.coalesce("m", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1))
    s = s.select("group", "id", "key", "h", "k", "m", other.alias("o"))
    cut = F.col("m").isNotNull()
    p = F.when(cut, F.least("k", "o")).otherwise(F.pmod(F.xxhash64("group"), F.lit(portions)).cast("int"))
    s = s.select(F.when(cut, F.col("group")).alias("g"), p.alias("p"), F.when(cut, F.greatest("k", "o")).otherwise(-1).alias("q"), "k", "group", "id", "key", "h")
    kind = sets.schema["id"].dataType.simpleString()

    def join(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = lambda c: t[c].chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
        sets, code, k = Sets(column("h")), column("group").dictionary_encode().indices.to_numpy(), column("k").to_numpy()
        order = np.argsort(code, kind="stable")
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            ends = np.unique(k[rows]) if t["q"][0].as_py() >= 0 else [0]
            found.append(sets.similar(rows, None, least) if len(ends) == 1 else sets.similar(rows[k[rows] == ends[0]], rows[k[rows] == ends[1]], least))
        a, b = (pa.array(np.concatenate(x)) for x in zip(*found))
        ids, keys = column("id"), column("key")
        swap = pa.compute.greater(ids.take(a), ids.take(b))
        one, two = pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b)
        out = pa.table({"group": column("group").take(one), "a": ids.take(one), "ka": keys.take(one), "b": ids.take(two), "kb": keys.take(two)})
        return out.filter(pa.compute.not_equal(out["a"], out["b"]))

    return s.groupBy("g", "p", "q").applyInArrow(join, f"group {sets.schema['group'].dataType.simpleString()}, a {kind}, ka binary, b {kind}, kb binary")
