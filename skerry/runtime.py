"""What every job needs of the session: tables, staged intermediate results, hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be sent to every executor.
SENT_BYTES = 64_000_000
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine, if the session runs on this machine alone;
    on a cluster it raises, since executors elsewhere couldn't read what others wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage with a columnar copy that outlives any executor, so that several later passes
    neither repeat the work nor depend on one executor's disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes all this process has staged, once no frame needs it any more; how many tables that were."""
    n = len(_STAGED)
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def hot_keys(df: DataFrame, key: str, rows: int, most: int = 1000) -> list:
    """Values of ``key`` that hold more than ``rows`` rows, by one map-side combined count.

    The bound is raised to a ``most``-th of all rows, so at most ``most`` keys reach the driver,
    whatever the size of the table. A null key is never reported.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    big = counts.filter(F.col("n") > rows).agg(F.count("*").alias("k"), F.min("n").alias("m"), F.sum("n").alias("s")).first()
    if not big["k"]:
        return []
    bound = max(rows, int(big["s"]) // most)
    return [r[0] for r in counts.filter(F.col("n") > bound).select(key).collect()]


def held_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory, by one pass: fixed widths as such, strings and arrays as long as they are."""

    def width(name: str, kind: T.DataType) -> Column | int:
        c = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c) + 8
        if isinstance(kind, T.ArrayType):
            each = kind.elementType
            inner = F.aggregate(c, F.lit(0), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0))) if isinstance(each, (T.StringType, T.BinaryType)) else F.lit(0)
            return F.size(c) * 16 + inner
        return 64 if isinstance(kind, (T.StructType, T.MapType)) else 8

    widths = [width(f.name, f.dataType) for f in df.schema.fields]
    fixed = 32 + sum(w for w in widths if isinstance(w, int))
    row = sum((F.coalesce(w, F.lit(0)) for w in widths if not isinstance(w, int)), F.lit(fixed)).cast("long")
    return df.agg(F.sum(row)).first()[0] or 0


def small(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df``, to be broadcast if its rows are measured to take at most ``most`` bytes; else left to a shuffled join.

    Measuring is a pass of its own, so ``df`` should be cheap to read again: staged, or a few columns of a table.
    """
    return F.broadcast(df) if held_bytes(df) <= most else df


def once(df: DataFrame) -> DataFrame:
    """The distinct rows of ``df``, of which only those of a repeated hash are compared and shuffled; for frames that are cheap to read again, with long rows that seldom repeat."""
    hashed = df.withColumn("_h", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))
    again = small(hashed.groupBy("_h").agg(F.count("*").alias("n")).filter("n > 1").select("_h"))
    return hashed.join(again, "_h", "left_anti").drop("_h").unionAll(hashed.join(again, "_h", "left_semi").drop("_h").distinct())


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(c: Column | str) -> Column:
    """A double without NaN: NaN and null are both missing."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)
