"""Facts and pages that keep arriving, by the same expressions as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from skerry.operators.flatten import flatten_facts
from skerry.operators.html import blocks


def arriving(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines that arrive as files under ``path``, at most ``files`` a round."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def arriving_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of arriving lines ``(ticker, json)``, flattened without state."""
    return flatten_facts(arriving(spark, path, "ticker string, json string"))


def arriving_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of arriving pages ``(doc_id, html)``."""
    return blocks(arriving(spark, path, "doc_id string, html string"))


def append(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends what has arrived to Parquet once each, then ends; ``each`` sees every round's rows instead, if given."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).outputMode("append").start()
