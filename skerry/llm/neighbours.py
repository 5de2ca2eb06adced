"""Problem 4: the nearest vectors of each vector, by an inverted file with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.runtime import staged


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids of ``x``; a centroid left without rows moves to a random row."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        c[own[order][at]] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(k), own)
        c[empty] = x[rng.integers(len(x), size=len(empty))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` centroids nearest to each row, nearest first, in blocks of bounded size."""
    n = min(n, len(c))
    half = 0.5 * (c * c).sum(1)
    out = np.empty((len(x), n), np.int32)
    step = max(1, 4_000_000 // len(c))
    for i in range(0, len(x), step):
        s = half - x[i : i + step] @ c.T
        if n == 1:
            out[i : i + step, 0] = s.argmin(1)
        else:
            part = np.argpartition(s, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(n), (len(s), 1))
            out[i : i + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    return out


class Index:
    """Coarse centroids and residual codebooks: ``lists x dim`` and ``parts x codes x dim / parts`` numbers.

    A vector's residual is kept in two: its part along the centroid, exactly, and the rest by its
    length and the product-quantised direction. So errors are in proportion to the rest, and none
    lies along the centroid, where rows of a dense cluster are longest and differ least.
    """

    def __init__(self, centroids: np.ndarray, books: np.ndarray):
        self.centroids, self.books = centroids, books
        self.norms = np.sqrt((centroids * centroids).sum(1))
        self.axes = centroids / np.maximum(self.norms, 1e-12)[:, None]

    def rest(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions of the residuals across the centroids, scaled to length 1; and ``(along, length)`` of each."""
        axis = self.axes[own]
        along = (x * axis).sum(1)
        r = x - along[:, None] * axis
        length = np.sqrt((r * r).sum(1))
        return r / np.maximum(length, 1e-12)[:, None], np.stack([along, length], axis=1).astype(np.float32)

    def codes(self, direction: np.ndarray) -> np.ndarray:
        w = self.books.shape[2]
        return np.stack([nearest(direction[:, j * w : (j + 1) * w], b, 1)[:, 0] for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: the product of each query's parts with every code."""
        w = self.books.shape[2]
        return np.stack([q[:, j * w : (j + 1) * w] @ b.T for j, b in enumerate(self.books)], axis=1)

    def decoded(self, codes: np.ndarray, scale: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for. A query's product with one is what its table entries sum to, for many at once by one matrix product."""
        axis = self.axes[own]
        d = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        d -= (d * axis).sum(1)[:, None] * axis
        return scale[:, :1] * axis + scale[:, 1:] * d


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """``(id, chunk_id, u)``: distinct rows with a vector of ``dim`` finite numbers, not all zero, scaled to unit length, as packed floats."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(2)), dim))
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                n = np.sqrt((x * x).sum(1))
                ok = (n > 0) & np.isfinite(n)
                u = (x[ok] / n[ok, None]).astype(np.float32)
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), _packed(u.reshape(-1, dim))], ["id", "chunk_id", "u"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("chunk_id").cast("string").alias("chunk_id"), "vec").filter("id IS NOT NULL AND vec IS NOT NULL")
    return rows.mapInArrow(scaled, "id long, chunk_id string, u binary").distinct()


def fit_index(unit: DataFrame, dim: int, n: int, least: int = 50_000, most: int = 500_000, for_books: int = 16_384, parts: int = 16, seed: int = 3) -> Index:
    """An index of about ``sqrt(n)`` lists, fitted on the rows with the smallest hashes of ``id``.

    16 rows a list are read, at least ``least`` and at most ``most``; the codebooks are fitted on the
    residuals of ``for_books`` of them. So lists and their lengths grow alike, up to a billion rows;
    beyond it lists grow alone, since each keeps its 16 rows of the sample.
    """
    rng = np.random.default_rng(seed)
    sample = min(most, max(least, 16 * round(n**0.5)))
    h = F.xxhash64(F.lit(seed), "id")
    near = unit if n <= sample else unit.filter(F.pmod(h, F.lit(1 << 30)) < int(1.05 * sample / n * (1 << 30)))
    rows = sorted((r["h"], r["id"], r["u"]) for r in near.select(h.alias("h"), "id", "u").collect())[:sample]
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, dim)
    c = kmeans(x, int(np.clip(round(n**0.5), 1, max(1, len(x) // 16))), 8, rng)
    x = x[:for_books]
    index, w = Index(c, np.zeros((parts, 1, dim // parts), np.float32)), dim // parts
    r, _ = index.rest(x, nearest(x, c, 1)[:, 0])
    index.books = np.stack([kmeans(r[:, j * w : (j + 1) * w], min(256, len(x)), 6, rng) for j in range(parts)])
    return index


def cells(centroids: np.ndarray, sizes: np.ndarray, rows: int, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``(first, span)`` of each list: the lists in cells of at most about ``rows`` rows, near ones together; a longer list has a span of cells of its own."""
    k = max(1, round(sizes.sum() / rows))
    own = nearest(centroids, kmeans(centroids, min(k, len(centroids)), 6, np.random.default_rng(seed)), 1)[:, 0] if k > 1 else np.zeros(len(centroids), int)
    first, span = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32)
    at, room = 0, rows
    for i in np.argsort(own, kind="stable"):
        if sizes[i] > room and room < rows:
            at, room = at + 1, rows
        first[i] = at
        if sizes[i] > rows:
            span[i] = -(-sizes[i] // rows)
            at, room = at + span[i], rows
        else:
            room -= sizes[i]
    return first, span


def _visits(lists: np.ndarray, first: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row of ``lists`` a cell at a time: ``(row, cell)`` of the visits, where their lists begin (with the end), and those lists."""
    flat = lists.ravel()
    many = span[flat]
    row, to = np.repeat(np.repeat(np.arange(len(lists)), lists.shape[1]), many), np.repeat(flat, many)
    cell = first[to] + (np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many))
    order = np.lexsort((to, cell, row))
    row, cell, to = row[order], cell[order], to[order]
    start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
    return row[start], cell[start].astype(np.int32), np.append(start, len(row)).astype(np.int32), to


def _at_least_top(s: np.ndarray, k: int, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of entries of ``s`` that hold the ``k`` greatest of each column, and few more.

    Of the greatest entries of runs of ``width`` rows, the ``k``-th is a bound that ``k`` entries reach.
    Entries within rounding of the bound count as equal to it; where there are many, the first ``k`` are taken.
    """
    m, n = s.shape
    g = m // width
    if g < 2 * k:
        if m <= k:
            return np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
        edge = np.partition(np.ascontiguousarray(s.T), m - k, axis=1)[:, m - k]
    else:
        runs = s[: g * width].reshape(g, width, n).max(1)
        edge = np.partition(np.ascontiguousarray(runs.T), g - k, axis=1)[:, g - k]
    at = np.flatnonzero((s >= edge - 1e-6).ravel())
    row, column = at // n, at % n
    if len(at) > 4 * k * n:
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        nth = np.arange(len(by)) - np.searchsorted(column, np.arange(n))[column]
        some = (nth < k) | (s[row, column] > edge[column] + 1e-6)
        row, column = row[some], column[some]
    return row, column


def _search(index: Index, left: pa.Table, right: pa.Table, dim: int, k: int, kept: int, rerank: int, block: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, other_id, cosine)``: for each query of ``left(id, u, lists)`` the ``k`` nearest among the rows of its lists in ``right(id, u, codes, scale, list)``."""
    own, xid = right.column("list").to_numpy(), right.column("id").to_numpy()
    order = np.lexsort((xid, own))  # so that of equal distances the least ids come first
    own, xid = own[order], xid[order]
    x = _matrix(right.column("u"), np.float32, dim)[order]
    codes, scale = _matrix(right.column("codes"), np.uint8, len(index.books))[order], _matrix(right.column("scale"), np.float32, 2)[order]
    decoded = index.decoded(codes, scale, own)
    q, qid = _matrix(left.column("u"), np.float32, dim), left.column("id").to_numpy()
    visited = left.column("lists").combine_chunks()
    visited = visited.chunk(0) if isinstance(visited, pa.ChunkedArray) else visited
    at, to = visited.offsets.to_numpy(), visited.values.to_numpy()
    here = np.flatnonzero(np.diff(own, prepend=-1))
    bounds = dict(zip(own[here].tolist(), zip(here.tolist(), np.append(here[1:], len(own)).tolist())))
    out: list[tuple] = []
    for i in range(0, len(q), block):
        b, n = q[i : i + block], min(block, len(q) - i)
        span = slice(at[i], at[i + n])
        who, where = np.repeat(np.arange(n), np.diff(at[i : i + n + 1])), to[span]
        by = np.argsort(where, kind="stable")
        starts = np.flatnonzero(np.diff(where[by], prepend=-1))
        found_q, found_x, found_s = [], [], []
        for j, end in zip(starts, np.append(starts[1:], len(by))):
            if (rows := bounds.get(int(where[by[j]]))) is None:
                continue
            step = max(1, 4_000_000 // (rows[1] - rows[0]))
            for m in range(j, end, step):
                asked = who[by[m : min(end, m + step)]]
                s = decoded[rows[0] : rows[1]] @ b[asked].T
                r, c = _at_least_top(s, kept)
                found_q.append(asked[c])
                found_x.append(r + rows[0])
                found_s.append(s[r, c])
        if not found_q:
            continue
        fq, fx, fs = (np.concatenate(f) for f in (found_q, found_x, found_s))
        other = qid[i + fq] != xid[fx]
        fq, fx, fs = fq[other], fx[other], fs[other]
        # The best of each query by table: one sort of its number and the distance, as whole numbers.
        key = (fq.astype(np.int64) << 32) | np.clip(np.round((2.0 - fs.astype(np.float64)) * 2**19), 0, 2**31).astype(np.int64)
        key_order = np.argsort(key, kind="stable")
        fq, fx = fq[key_order], fx[key_order]
        nth = np.arange(len(fq)) - np.searchsorted(fq, np.arange(n))[fq] if len(fq) else fq
        fq, fx = fq[nth < rerank], fx[nth < rerank]
        sim = np.empty(len(fq))
        for j in range(0, len(fq), 65_536):
            t = slice(j, j + 65_536)
            sim[t] = np.einsum("ij,ij->i", b[fq[t]].astype(np.float64), x[fx[t]].astype(np.float64))
        sim = np.round(sim, 6)
        exact = np.lexsort((xid[fx], -sim, fq))
        fq, fx, sim = fq[exact], fx[exact], sim[exact]
        nth = np.arange(len(fq)) - np.searchsorted(fq, np.arange(n))[fq] if len(fq) else fq
        fq, fx, sim = fq[nth < k], fx[nth < k], sim[nth < k]
        out.append((qid[i + fq], xid[fx], sim))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(o) for o in zip(*out))


def nearest_rows(unit: DataFrame, k: int, probes: int, kept: int, rerank: int, every: int, dim: int, cell: int, part: int) -> DataFrame:
    """``(id, other_id, cosine)`` of :func:`similar` for a staged ``unit(id, u)`` that isn't empty."""
    spark = unit.sparkSession
    n = unit.count()
    index = fit_index(unit, dim, n)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), np.float32, dim)
            own = nearest(x, index.centroids, 1)[:, 0]
            direction, scale = index.rest(x, own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(index.codes(direction)), _packed(scale), pa.array(own, pa.int32())], ["id", "u", "codes", "scale", "list"])

    placed = staged(unit.select("id", "u").mapInArrow(listed, "id long, u binary, codes binary, scale binary, list int"))
    # The driver sees one count a list.
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    first, span = cells(index.centroids, sizes, cell)
    n_cells = int((first + span).max())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                row, to, at, lists = _visits(nearest(_matrix(b.column(1), np.float32, dim), index.centroids, probes), first, span)
                b = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to), pa.ListArray.from_arrays(pa.array(at), pa.array(lists, pa.int32()))], ["id", "u", "cell", "lists"])

    queries = unit.filter(F.col("id") % every == 0).select("id", "u")
    asked = queries.mapInArrow(visit, "id long, u binary, cell int, lists array<int>")
    # Queries of a cell are split into parts of about ``part``, by counts beforehand where there are many; that changes tasks, not results.
    n_queries = queries.count() if every > 1 else n
    if n_queries > 4 * part:
        parts = {r["cell"]: -(-r["n"] // part) for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    else:
        slots = -(-2 * spark.sparkContext.defaultParallelism // n_cells)
        parts = dict.fromkeys(range(n_cells), max(-(-n_queries // part), min(slots, -(-n_queries // 2048)), 1))
    table = spark.createDataFrame([(int(i), int(first[i]), int(span[i])) for i in np.flatnonzero(sizes)], "list int, first int, span int")
    counts = spark.createDataFrame([(int(c), int(p)) for c, p in parts.items()] or [(0, 1)], "cell int, parts int")
    # One row a list and one a cell.
    placed = placed.join(F.broadcast(table), "list").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("span"))).cast("int"))
    placed = placed.join(F.broadcast(counts), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "u", "codes", "scale", "list")
    asked = asked.join(F.broadcast(counts), "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"), "id", "u", "lists")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _search(index, left, right, dim, k, kept, rerank) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": pa.array(found[0], pa.int64()), "other_id": pa.array(found[1], pa.int64()), "cosine": pa.array(found[2], pa.float64())})

    return asked.groupBy("cell", "part").cogroup(placed.groupBy("cell", "part")).applyInArrow(compare, "id long, other_id long, cosine double")


def _ranked(vectors: DataFrame, k: int, probes: int, kept: int, rerank: int, every: int, dim: int, cell: int, part: int) -> tuple[DataFrame, DataFrame]:
    """``(id, rank, other_id, cosine)`` of :func:`similar`, and the ``(id, chunk_id)`` of all usable rows."""
    everything = staged(usable(vectors, dim).withColumn("direction", F.xxhash64("u")))
    place = F.row_number().over(Window.partitionBy("direction", "u").orderBy("id"))
    unit = staged(everything.withColumn("place", place).filter(F.col("place") <= k + 1))
    names = everything.select("id", "chunk_id")
    if unit.isEmpty():
        return unit.sparkSession.createDataFrame([], "id long, rank int, other_id long, cosine double"), names
    alike = unit.filter(F.col("place") <= k).groupBy("direction", "u").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("first"), F.count("*").alias("n")).filter(F.col("n") == k)
    rest = everything.filter(F.col("id") % every == 0).join(unit.select("id"), "id", "left_anti").join(alike, ["direction", "u"]).select("id", F.explode("first").alias("f"))
    copies = rest.select("id", F.col("f.place").alias("rank"), F.col("f.id").alias("other_id"), F.lit(1.0).alias("cosine"))
    found = nearest_rows(unit, k, probes, kept, rerank, every, dim, cell, part)
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("id", "rank", "other_id", "cosine").unionByName(copies), names


def similar(vectors: DataFrame, k: int = 5, probes: int = 64, kept: int = 12, rerank: int = 64, every: int = 1, dim: int = 64, cell: int = 32_768, part: int = 65_536) -> DataFrame:
    """``(id, chunk_id, rank, other_id, other_chunk_id, cosine)``: for each usable row whose id is divisible by ``every``, its ``k`` most similar rows.

    Every usable row is indexed: it goes to the list of its nearest centroid with the codes of its
    residual. A query visits the ``probes`` nearest lists; in each, asymmetric distances to the codes
    pick about the ``kept`` best, of those the ``rerank`` best of a cell's lists are kept, and their
    exact cosines (rounded to 6 digits, ties by id) decide. There are about as many lists as
    rows in each, so a query looks at ``probes`` times the root of all rows.

    Lists near one another form cells of about ``cell`` rows, and a cell with a part of its queries
    is one group's work, so a query travels once a cell. A longer list is split over several cells
    and a cell's queries into parts of ``part``, so one that a third of all rows fall into is many
    tasks' work. Cells keep the unit vectors beside the codes, so reranking needs no join.

    Rows of exactly the same direction are alike to every query, so of each direction only the
    ``k + 1`` rows of least id are indexed and searched: no more can be among any row's ``k`` most
    similar, and the others' are these. So copies that a third of all rows are cost no comparisons.

    Vectors that are null, all zero, of another length, or hold nulls or NaN are neither queries nor
    results. Repeated rows count once; rows of equal direction find each other with cosine 1, ties
    by id. ``chunk_id`` may be null. An empty table gives an empty result.
    """
    best, names = _ranked(vectors, k, probes, kept, rerank, every, dim, cell, part)
    return best.join(names, "id").join(names.toDF("other_id", "other_chunk_id"), "other_id").select("id", "chunk_id", "rank", "other_id", "other_chunk_id", "cosine")


def close_pairs(vectors: DataFrame, least: float = 0.9, k: int = 5, **how: int) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: rows whose cosine is at least ``least``, one among the ``k`` most similar of the other.

    The search is that of :func:`similar`, for every row, and ``how`` its parameters.
    """
    given = {"probes": 64, "kept": 12, "rerank": 64, "dim": 64, "cell": 32_768, "part": 65_536} | how
    s = _ranked(vectors, k=k, every=1, **given)[0].filter(F.col("cosine") >= least)
    return s.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()
