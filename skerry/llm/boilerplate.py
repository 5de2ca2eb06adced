"""Problem 6: lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import staged


def same_line(line: Column) -> Column:
    """Lower case, ``#`` for each run of digits, one space for each run of white space, trimmed; Unicode digits and white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "#"), r"(?U)[\s\x1c-\x1f]+", " "))


def numbered_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line_no, source_key, line_key)`` of every line that isn't empty in texts of kind text, by hash."""
    rows = chunks.filter("kind = 'text' AND text IS NOT NULL AND chunk_id IS NOT NULL")
    none = F.lit("\u0000")
    rows = rows.select("chunk_id", F.xxhash64(F.coalesce("ticker", none), F.coalesce("form", none)).alias("source_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", same_line(F.col("line"))).filter("line <> ''")
    return rows.select("chunk_id", (F.col("line_no") + 1).alias("line_no"), "source_key", F.xxhash64("source_key", "line").alias("line_key"))


def frequent_lines(lines: DataFrame, min_docs: int = 6, min_share: float = 0.0) -> DataFrame:
    """``(line_key, n_docs)`` of the lines in at least ``min_docs`` documents of their source that are also ``min_share`` of them."""
    docs = lines.select("source_key", "line_key", F.xxhash64("chunk_id").alias("doc")).distinct()
    found = docs.groupBy("line_key").agg(F.count("*").alias("n_docs"), F.first("source_key").alias("source_key")).filter(F.col("n_docs") >= min_docs)
    if min_share > 0:
        size = lines.select("source_key", F.xxhash64("chunk_id").alias("doc")).distinct().groupBy("source_key").agg(F.count("*").alias("size"))
        found = found.join(size, "source_key").filter(F.col("n_docs") >= min_share * F.col("size"))
    return found.select("line_key", "n_docs")


def repeated_lines(chunks: DataFrame, min_docs: int = 6, min_share: float = 0.0) -> DataFrame:
    """``(chunk_id, line_no)``, ``line_no`` from 1: lines that at least ``min_docs`` chunks of the same ``ticker`` and ``form`` hold.

    A line counts once for each chunk, and a repeated row once. Lines are compared by 64-bit hash of
    their normal form and source. A null ``ticker`` or ``form`` is a source of its own; null and
    empty texts, tables, and rows without ``chunk_id`` have no lines. The count is combined before
    each shuffle, so a line that a third of all chunks carry arrives as few rows; the join back
    needs only the frequent lines and splits a hot one under AQE.
    """
    lines = staged(numbered_lines(chunks))  # texts are cut into lines once
    return lines.join(frequent_lines(lines, min_docs, min_share), "line_key", "left_semi").select("chunk_id", "line_no").distinct()


def without_repeated_lines(chunks: DataFrame, min_docs: int = 6, min_share: float = 0.0) -> DataFrame:
    """``(chunk_id, text, n_removed)``: every text without those lines; the other lines are kept as they are, in order.

    Tables and texts without such a line come out unchanged, null stays null, and a text of nothing
    but such lines becomes empty. Repeated rows come out once.
    """
    drop = repeated_lines(chunks, min_docs, min_share).groupBy("chunk_id").agg(F.collect_set("line_no").alias("_drop"))
    rows = chunks.select("chunk_id", "kind", "text").distinct().join(drop, "chunk_id", "left")
    hit = F.col("_drop").isNotNull() & (F.col("kind") == "text") & F.col("text").isNotNull()
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_drop", i + 1)), "\n")
    return rows.select("chunk_id", F.when(hit, kept).otherwise(F.col("text")).alias("text"), F.when(hit, F.size("_drop")).otherwise(0).alias("n_removed"))
