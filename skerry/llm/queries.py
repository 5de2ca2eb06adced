"""The pN_ queries over the tables of a data directory, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import boilerplate, chunking, distinctive, fusion, lookalike, mixing, neardup, neighbours, packing, quality
from skerry.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rank_fusion(table(spark, d, "hits")).filter("fused_rank = 1").select("qid", "chunk_id")


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rank_fusion(table(spark, d, "hits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "chunks")).filter("piece_no = 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "chunks"))


def p2_properties(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text come to: the text put together again, the longest piece, the most that is repeated."""
    p = chunking.pieces(table(spark, d, "chunks"))
    body = F.substr("text", F.col("body_start") - F.col("start") + 1)
    whole = p.groupBy("chunk_id", "item", "text_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", body.alias("b")))), lambda x: x["b"]), "").alias("t"), F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.max(F.col("body_start") - F.col("start")).alias("repeated"))
    return whole.select("chunk_id", "item", F.md5("t").alias("md5"), (F.col("n") > 1).alias("is_cut"), (F.col("longest") <= 2400).alias("within_limit"), (F.col("repeated") <= 200).alias("within_overlap")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.close_pairs(table(spark, d, "chunks"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.close_pairs(table(spark, d, "vectors"))


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar(table(spark, d, "vectors"), every=100)


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(lookalike.texts_of(table(spark, d, "chunks"), table(spark, d, "eval_narrative")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_texts(spark, d).filter("n_changed > 0").select("tbl", "record_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "chunks"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.typical_terms(table(spark, d, "chunks")).select("chunk_id", "term")


def p7_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.log_entropy(table(spark, d, "chunks"))


def p7_questions(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.question_overlap(table(spark, d, "eval_narrative"), table(spark, d, "chunks"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_sizes(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_items(p8_containers(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).filter("capped").select("source")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return quality.classified(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_classes(spark, d).filter("text_class <> 'prose'").select("doc_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from skerry.llm.sql import SQL

    return SQL
