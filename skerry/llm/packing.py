"""Problem 8: items into containers of fixed capacity, by a configuration linear program."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.tokens import VOCABULARY, token_count
from skerry.runtime import staged


class Knapsack:
    """Unbounded knapsack over ascending ``sizes``: the greatest worth of every capacity up to ``capacity``, and the choices behind it."""

    def __init__(self, sizes: np.ndarray, worth: np.ndarray, capacity: int):
        self.sizes = sizes
        self.best = best = np.zeros(capacity + 1)
        self.pick = pick = np.full(capacity + 1, -1)
        fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        # Larger sizes reach back over a whole block of capacities, which are looked at together; smaller ones only one by one.
        block = 32
        low = int(np.searchsorted(sizes, block))
        for at in range(1, capacity + 1, block):
            to = min(at + block, capacity + 1)
            c = np.arange(at, to)
            if k := int(fit[to - 1]) - low:
                back = c[:, None] - sizes[None, low : low + k]
                v = np.where(back >= 0, best[np.maximum(back, 0)] + worth[low : low + k], -1.0)
                i = v.argmax(1)
                best[at:to], pick[at:to] = v[np.arange(len(c)), i], i + low
            for x in range(at, to):
                if best[x - 1] >= best[x]:
                    best[x], pick[x] = best[x - 1], -1
                if m := min(low, int(fit[x])):
                    v1 = best[x - sizes[:m]] + worth[:m]
                    i1 = int(v1.argmax())
                    if v1[i1] > best[x]:
                        best[x], pick[x] = v1[i1], i1

    def configuration(self, counts: np.ndarray, with_size: int | None = None) -> np.ndarray:
        """How many of each size fill the capacity at the greatest worth, or at the greatest with at least one of a given size; no more than ``counts`` of each."""
        a = np.zeros(len(self.sizes), np.int64)
        c = len(self.best) - 1
        if with_size is not None:
            a[with_size] = 1
            c -= int(self.sizes[with_size])
        while c > 0:
            i = self.pick[c]
            if i < 0:
                c -= 1
            else:
                a[i] += 1
                c -= int(self.sizes[i])
        return np.minimum(a, counts)


def fill(sizes: np.ndarray, counts: np.ndarray, capacity: int, a: np.ndarray) -> np.ndarray:
    """``a`` with what still fits: repeatedly the largest size left. ``sizes`` ascend."""
    a = a.copy()
    room = capacity - int(a @ sizes)
    for i in range(int(np.searchsorted(sizes, room, side="right")) - 1, -1, -1):
        if sizes[i] <= room and (n := min(int(counts[i] - a[i]), room // int(sizes[i]))) > 0:
            a[i] += n
            room -= n * int(sizes[i])
    return a


def program(s: np.ndarray, d: np.ndarray, capacity: int, rounds: int = 60, columns: int = 32, steep: float = 8.0) -> list[tuple[np.ndarray, float]]:
    """A fractional solution of the covering program: ``(items of each size, containers)``, the sizes ``s`` (ascending) covered by their counts ``d``.

    Prices start halfway between an item's share of a container and that of the containers it needs
    alone, and by multiplicative weights fall as a size is covered. One dynamic program a round
    prices the configuration of greatest worth and, for each of the ``columns`` sizes covered least,
    the best one that holds it; each is taken as often as the scarcest of its sizes allows. What
    covers more than once is scaled down.
    """
    covered = np.zeros(len(s))
    base = 0.5 * s / capacity + 0.5 / (capacity // s)
    chosen: dict[bytes, float] = {}
    for _ in range(rounds):
        least = covered.min()
        if least >= 1.0:
            break
        table = Knapsack(s, base * np.exp(-steep * (covered - least)) / d, capacity)
        # A size that a column before has covered meanwhile is passed over.
        bound = np.sort(covered)[min(columns, len(s)) - 1]
        for i in [None, *np.argsort(covered, kind="stable")[:columns]]:
            if i is not None and (covered[i] >= 1.0 or covered[i] > bound):
                continue
            a = table.configuration(d, i)
            if a.any():
                step = float((d[a > 0] / a[a > 0]).min())
                chosen[a.tobytes()] = chosen.get(a.tobytes(), 0.0) + step
                covered += step * a / d
    scale = 1.0 / max(1.0, float(np.average(covered, weights=d * s)))
    return sorted(((np.frombuffer(k, np.int64), x * scale) for k, x in chosen.items()), key=lambda kv: -kv[1])


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, passes: int = 3, spare: float = 0.001) -> list[tuple[np.ndarray, int]]:
    """``(items of each size, containers)``: patterns that hold every item of the histogram, exactly.

    The covering program (:func:`program`) asks for the fewest containers. Its multiplicities are
    rounded up as far as the items left allow, the largest first. A configuration whose items are partly
    gone, or that leaves more than ``spare`` of a container free, is repaired by filling it up with
    items left, and not used if that doesn't do. The program is then solved again for what is left,
    until it places nothing or ``passes`` are over. The rest is filled largest first, each pattern as
    full as any choice of items makes it and as often as it fits, which ends after at most one
    pattern a size. Of the plans after each pass the last is taken that needs at most 0.05 % more
    containers than the best. Work depends on ``capacity`` and the bounds here, not on the number of items.
    """
    return [(a, m) for a, m, _ in _patterns(sizes, counts, capacity, passes, spare)]


def placed_by_program(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> float:
    """The share of containers that the program fills; the others are filled largest first."""
    found = _patterns(sizes, counts, capacity, 3, 0.001)
    return sum(m for _, m, solved in found if solved) / max(1, sum(m for _, m, _ in found))


def _patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int, passes: int, spare: float) -> list[tuple[np.ndarray, int, bool]]:
    at = np.flatnonzero(counts > 0)
    order = at[np.argsort(sizes[at])]
    s, left = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    solved: list[tuple[np.ndarray, int, bool]] = []
    plans = []
    for _ in range(passes):
        some = np.flatnonzero(left)
        placed = 0
        for part, x in program(s[some], left[some], capacity) if len(some) else []:
            a = np.zeros(len(s), np.int64)
            a[some] = part
            a = np.minimum(a, left)
            if a @ s < 0.9 * capacity:
                continue
            if a @ s < (1 - spare) * capacity:
                a = exact_fill(s, left, capacity, a)
            m = min(int(np.ceil(x - 1e-9)), int((left[a > 0] // a[a > 0]).min()))
            if a @ s >= (1 - spare) * capacity:
                solved.append((a, m, True))
                left -= m * a
                placed += m
        plans.append(solved + [(a, m, False) for a, m in _largest_first(s, left, capacity)])
        if not placed:
            break
    needs = [sum(m for _, m, _ in p) for p in plans]
    best = next(p for p, n in zip(reversed(plans), reversed(needs)) if n <= 1.0005 * min(needs))
    out = []
    for a, m, by_program in best:
        x = np.zeros(len(sizes), np.int64)
        x[order] = a
        out.append((x, int(m), by_program))
    return out


def _largest_first(s: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that each begin with the largest size left and is as full as any choice of items makes them, as often as they fit."""
    left, found = counts.copy(), []
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        a = np.zeros(len(s), np.int64)
        a[top] = 1
        a = exact_fill(s, left, capacity, a)
        m = int((left[a > 0] // a[a > 0]).min())
        found.append((a, m))
        left -= m * a
    return found


def exact_fill(sizes: np.ndarray, counts: np.ndarray, capacity: int, a: np.ndarray) -> np.ndarray:
    """``a`` filled as far as any choice of the items left can, by reachable sums over sizes in descending order; one of each size at a time."""
    room = capacity - int(a @ sizes)
    greedy = fill(sizes, counts, capacity, a)
    if int(greedy @ sizes) == capacity or room <= 0:
        return greedy
    first = np.full(room + 1, -1)  # the size that first reached each sum
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for i in range(int(np.searchsorted(sizes, room, side="right")) - 1, -1, -1):
        free = int(counts[i] - a[i])
        if free <= 0:
            continue
        z = int(sizes[i])
        new = np.zeros(room + 1, bool)
        new[z:] = reached[: room + 1 - z]
        new &= ~reached
        first[new] = i
        reached |= new
        if reached[room]:
            break
    total = int(np.flatnonzero(reached)[-1])
    if total <= int(greedy @ sizes) - int(a @ sizes):
        return greedy
    b = a.copy()
    while total > 0:
        b[first[total]] += 1
        total -= int(sizes[first[total]])
    return b


def items(docs: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(<key>, piece_no, first, size)``: an item whole, or in full pieces and a remainder if it exceeds ``capacity``; sizes of 0 take no room and are left out."""
    n = F.col(size)
    rows = docs.filter(n > 0).withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))))
    first = F.col("piece_no") * capacity
    return rows.select(key, "piece_no", first.alias("first"), F.least(F.lit(capacity), n - first).cast("int").alias("size"))


def pack(docs: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, salts: int = 64) -> DataFrame:
    """``(<key>, piece_no, first, size, container_id)``: every item in a container, none over ``capacity``, none split but those over it.

    The driver sees the histogram of lengths, at most ``capacity * salts`` counts; patterns are found
    on it (``configurations``) and rows fill them by their rank within their length. That rank is a
    row number inside one of ``salts`` parts of the length plus the counts of the parts before, so a
    length that a third of all rows share is spread over many tasks.

    Null or non-positive sizes take no container. ``key`` must be unique. An empty table gives an
    empty result. The assignment is the same in every run.
    """
    it = staged(items(docs, key, size, capacity).withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int")))
    found = it.groupBy("size", "_salt").agg(F.count("*").alias("n")).collect()
    hist = np.zeros((capacity + 1, salts), np.int64)
    for r in found:
        hist[r["size"], r["_salt"]] = r["n"]
    counts = hist.sum(1)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])  # global rank of the first item of each size
    before = np.cumsum(hist, axis=1) - hist
    filled = counts.copy() * 0
    starts, firsts, copies, at = [], [], [], 0
    for a, m in configurations(np.arange(capacity + 1), np.where(np.arange(capacity + 1) > 0, counts, 0), capacity):
        for i in np.flatnonzero(a):
            starts.append(base[i] + filled[i])
            firsts.append(at)
            copies.append(int(a[i]))
            filled[i] += int(a[i]) * m
        at += m
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    starts_, firsts_, copies_ = (np.array(x, np.int64)[order] for x in (starts, firsts, copies))
    offset = base[:, None] + before

    @F.pandas_udf("long")
    def container(sizes: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.Series:
        g = offset[sizes.to_numpy(), salt.to_numpy()] + rank.to_numpy() - 1
        e = np.searchsorted(starts_, g, side="right") - 1
        return pd.Series(firsts_[e] + (g - starts_[e]) // copies_[e])

    rank = F.row_number().over(Window.partitionBy("size", "_salt").orderBy(key, "piece_no"))
    return it.withColumn("_rank", rank).select(key, "piece_no", "first", "size", container("size", "_salt", "_rank").alias("container_id"))


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every distinct document with a text. Staged, so that each text is measured once."""
    sized = documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''").select("doc_id", token_count("text", vocabulary).alias("n_tokens"))
    return staged(sized.distinct())


def split_items(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(<key>)`` of the items that :func:`pack` had to spread over several containers: those that exceed one."""
    where = packed.groupBy(key).agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return where.filter("a <> b").select(key)
