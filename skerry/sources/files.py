"""JSON lines, whole pages, result files and the search index on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import embed_text
from skerry.functions.vectors import unit
from skerry.operators.retrieval import postings
from skerry.runtime import once

CHUNK = "doc_id string, chunk_id string, ticker string, company string, form string, report_date string, accession string, item string, item_title string, kind string, text string, breadcrumb string, source_url string, n_chars int"
NUMERIC_QUESTION = "qid string, question string, ticker string, concept string, fiscal_year string, expected_value double, unit string, gold_chunk_ids array<string>, split string, source string"
NARRATIVE_QUESTION = "qid string, question string, topic string, ticker string, item string, fiscal_year string, gold_chunk_ids array<string>, idf_overlap double, split string, source string"


def read_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are passed over, a line that isn't JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, characters outside ASCII as they are, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_questions(spark: SparkSession, paths: list[tuple[str, str]]) -> DataFrame:
    """Sets of questions, ``(path, schema)`` each, as one: columns a set lacks are null, fiscal years numbers; without a split it is numeric."""
    sets = [read_lines(spark, p, s) for p, s in paths]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    return out.withColumn("fiscal_year", question_year("fiscal_year")).withColumn("split", F.coalesce("split", F.lit("numeric")))


def question_year(c: str) -> Column:
    """A fiscal year written as ``2015``, ``FY2015``, ``fiscal 2015`` or ``FY15`` as a number; null if there is none."""
    x = F.col(c).cast("string")
    four, two = F.regexp_extract(x, r"(?<!\d)(\d{4})(?!\d)", 1), F.regexp_extract(x, r"(?i)fy\s*'?(\d\d)(?!\d)", 1)
    return F.coalesce(F.nullif(four, F.lit("")).try_cast("int"), F.nullif(two, F.lit("")).try_cast("int") + 2000)


def read_pages(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(path, html)`` of whole files, bytes that aren't text replaced."""
    raw = F.col("content").cast("string") if encoding == "UTF-8" else F.decode("content", encoding)
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(raw).alias("html"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, json)`` of whole JSON files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def write_report(summary: DataFrame, path: str) -> None:
    """A result as JSON: one line a row, its columns nested as they are."""
    summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(summary: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small summary as a table; more than ``most`` rows raise."""
    rows = summary.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: f"{x:.3f}" if isinstance(x, float) else "" if x is None else str(x)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)]) + "\n"


class Index:
    """The tables of a search index: ``chunks``, ``vectors(id, vec)``, ``postings(term, id, tf)``, ``lengths(id, dl)``, ``terms(term, df)``, ``meta``."""

    TABLES = ("chunks", "vectors", "postings", "lengths", "terms", "meta")

    def __init__(self, **tables: DataFrame):
        self.__dict__.update(tables)

    @classmethod
    def build(cls, chunks: DataFrame, vectors: DataFrame, model: str) -> Index:
        """From chunks and their vectors by chunk id; the sparse side sees breadcrumb and text. Repeated rows count once."""
        corpus = once(chunks.select(F.col("chunk_id").alias("id"), F.coalesce(embed_text("breadcrumb", "text"), "text").alias("text")))
        chunks = once(chunks)
        post, lengths, terms = postings(corpus)
        unit_vectors = vectors.filter("vec IS NOT NULL").select("id", unit("vec").alias("vec")).distinct()
        meta = chunks.agg(F.countDistinct("chunk_id").alias("n_chunks")).withColumn("embed_model", F.lit(model))
        return cls(chunks=chunks, vectors=unit_vectors, postings=post, lengths=lengths, terms=terms, meta=meta)

    def save(self, path: str) -> None:
        """As Parquet; postings sorted by term, so that a question reads few row groups."""
        for t in self.TABLES:
            df = getattr(self, t)
            (df.repartitionByRange("term").sortWithinPartitions("term") if t == "postings" else df).write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(**{t: spark.read.parquet(f"{path}/{t}") for t in cls.TABLES})
