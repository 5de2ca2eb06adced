"""Problem 2: pieces under a size limit, cut by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 32  # characters that the rolling hash sees
PIECES = "array<struct<start: int, end: int, body_start: int, text: string>>"


def rolling_hash(cp: np.ndarray) -> np.ndarray:
    """Hash of the ``SPAN`` characters that end at each position, the same wherever those characters stand."""
    h = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = 1
    while step < SPAN:  # the hash of 2n characters out of two hashes of n
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step]
        h = h + shifted * np.uint64(pow(0x100000001B3, step, 1 << 64))
        step *= 2
    return h ^ (h >> np.uint64(31))


def boundaries(text: str, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where text may be cut, best kinds first: after a line or a sentence; after white space."""
    n = len(cp)
    line = cp == 10
    space = np.isin(cp, (9, 10, 13, 32, 0xA0, 0x2028, 0x2029, 0x3000))
    stop = np.isin(cp, (33, 46, 63, 0x2026, 0x3002, 0xFF01, 0xFF1F))
    strong = np.zeros(n + 1, bool)
    strong[1:] = line
    if n > 1:
        strong[2:] |= space[1:] & stop[:-1]
        strong[1:-1] &= ~line[1:]  # a run of line ends is cut after its last
    weak = np.zeros(n + 1, bool)
    weak[1:] = space
    return np.flatnonzero(strong), np.flatnonzero(weak)


def cut(text: str, limit: int = 2400, overlap: int = 200, least: int = 600, bits: int = 9) -> list[tuple[int, int, int]]:
    """``(start, end, body start)`` of the pieces of ``text``.

    Bodies tile the text; a piece starts up to ``overlap`` characters before its body. A landmark is
    a position whose rolling hash ends in ``bits`` zeros. From the body's start, the first landmark
    at least ``least`` on (else the furthest position allowed) snaps to the nearest line or sentence
    end within the allowed sizes, else to the nearest white space, else it is the cut, moved back
    over combining characters. Landmarks depend on ``SPAN`` characters only, so cuts fall into step
    again soon after an edit.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    strong, weak = boundaries(text, cp)
    marks = np.flatnonzero((rolling_hash(cp) & np.uint64((1 << bits) - 1)) == 0) + 1
    most = limit - overlap
    out, at = [], 0
    while at < n:
        if n - at <= most:
            end = n
        else:
            lo, hi = at + least, at + most
            i = np.searchsorted(marks, lo)
            want = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
            end = 0
            for kind in (strong, weak):
                a, b = np.searchsorted(kind, (lo, hi + 1))
                if a < b:
                    near = kind[a:b]
                    end = int(near[np.argmin(np.abs(near - want))])
                    break
            if not end:
                end = want
                while end > lo and (0x300 <= cp[end] <= 0x36F or cp[end] == 0x200D or cp[end - 1] == 0x200D or 0xFE00 <= cp[end] <= 0xFE0F):
                    end -= 1
        start = at
        if at:
            low = max(at - overlap, out[-1][2])
            start = low
            for kind in (strong, weak):
                a, b = np.searchsorted(kind, (low, at))
                if a < b:
                    start = int(kind[a])
                    break
        out.append((start, end, at))
        at = end
    return out


def pieces(chunks: DataFrame, limit: int = 2400, overlap: int = 200, least: int = 600) -> DataFrame:
    """``(chunk_id, item, piece_no, start, end, body_start, text, text_key)``: every text in pieces of at most ``limit`` characters.

    ``start`` and ``end`` count characters from 0; ``text_key`` is a hash of the whole text; ``text[start:body_start]`` is what a piece repeats
    of the one before; the bodies together are the text, exactly. Length is measured, ``n_chars`` is
    not looked at. A text within the limit, or empty, is one piece; a null text has none. Repeated
    rows count once; rows that differ in text or ``item`` under one ``chunk_id`` are each cut. Extra
    columns are ignored. Only texts over the limit go to Python, a row at a time, so a very long
    text costs its own length only.
    """

    @F.pandas_udf(PIECES)
    def cut_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"start": s, "end": e, "body_start": b, "text": t[s:e]} for s, e, b in cut(t, limit, overlap, least)] for t in batch], dtype=object)

    # Long and short texts are deduplicated together, before any text is cut.
    rows = chunks.select("chunk_id", "item", "text").filter("text IS NOT NULL")
    n = F.length("text")
    zero = F.lit(0)
    short = rows.filter(n <= limit).distinct().select("chunk_id", "item", zero.alias("piece_no"), zero.alias("start"), n.alias("end"), zero.alias("body_start"), "text", F.xxhash64("text").alias("text_key"))
    long = rows.filter(n > limit).distinct().withColumn("p", cut_all("text")).select("chunk_id", "item", F.xxhash64("text").alias("text_key"), F.posexplode("p").alias("piece_no", "p"))
    return short.unionByName(long.select("chunk_id", "item", "piece_no", "p.start", "p.end", "p.body_start", "p.text", "text_key"))
