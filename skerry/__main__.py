"""``python -m skerry COMMAND``: the whole jobs from the command line. ``SKERRY_*`` variables are the options' defaults."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import metrics
from skerry.plans import catalog, eval_sets, retrieval as plans
from skerry.runtime import release, staged
from skerry.sources import clients, files, providers


def embedder(a: argparse.Namespace):
    return clients.HttpEmbedder(a.embed_url, a.embed_model, a.key) if a.embed_url else providers.HashEmbedder()


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    vectors = providers.embedded(catalog.corpus(spark, a.data), embedder(a), "passage")
    files.Index.build(catalog.chunks(spark, a.data), staged(vectors), a.embed_model or "hashed words").save(a.out)


def eval_set(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.kind == "numeric":
        concepts = spark.read.csv(a.concepts, header=True, schema="concept string, label string") if a.concepts else None
        facts = eval_sets.eligible_facts(catalog.facts_of(spark, a.data), concepts)
        out = eval_sets.numeric_questions(facts, catalog.chunks(spark, a.data, "chunk_id", "ticker", "report_date", "text"), ["filed", "accession", "val", "unit", "label"], per_ticker=a.per_ticker)
    else:
        if not a.chat_url:
            raise SystemExit("narrative questions are written by a model: --chat-url is needed")
        c = catalog.chunks(spark, a.data)
        p = staged(eval_sets.narrative_passages(c, catalog.ITEMS))
        asked = eval_sets.writer_prompts(eval_sets.to_ask(p, a.per_ticker))
        answers = staged(providers.answered(asked, clients.HttpChat(a.chat_url, key=a.key), a.chat_model.split(","), bool))
        near = map(staged, catalog.labels.similar_sets(p.select("chunk_id", "ticker", "text").toDF("id", "group", "text")))
        out, refused = eval_sets.narrative_questions(p, answers, c.select(F.col("chunk_id").alias("id"), "text").distinct(), *near, per_ticker=a.per_ticker)
        print(files.markdown(refused, ["reason", "n"]))
    files.write_lines(out, a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    q = catalog.questions(spark, a.data)
    q = q.orderBy("qid").limit(a.limit) if a.limit else q
    h = catalog.lists(spark, a.data)
    scored = staged(plans.ablation(h, catalog.logits(h), catalog.gold(spark, a.data), q))
    n = catalog.chunks(spark, a.data, "chunk_id").count()
    files.write_report(plans.ablation_result(scored, q, ["eval_narrative"], n, a.embed_model, a.limit), a.out)
    print(files.markdown(metrics.mean_metrics(scored, ("config", "split"), also_all=True).orderBy("split", "config"), ["split", "config", "n", *metrics.METRICS]))


def shown(name: str, *order: str):
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        df: DataFrame = staged(catalog.QUERIES[name](spark, a.data))
        files.write_report(df, a.out)
        print(files.markdown(df.orderBy(*order) if order else df, df.columns))

    return run


COMMANDS = {
    "build-index": build_index,
    "eval-set": eval_set,
    "evaluate": evaluate,
    "sweep": shown("convex_sweep", "split", "alpha"),
    "weights": shown("dat_report"),
}


def options() -> argparse.ArgumentParser:
    env = lambda name, default="": os.environ.get(f"SKERRY_{name}", default)
    p = argparse.ArgumentParser(prog="skerry", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", default=env("DATA"), help="folder of Parquet tables")
    p.add_argument("--out", default=env("OUT"), help="where the result is written")
    p.add_argument("--kind", choices=("numeric", "narrative"), default="numeric", help="of an eval set")
    p.add_argument("--concepts", default=env("CONCEPTS"), help="CSV of concept and label that numeric questions keep to")
    p.add_argument("--per-ticker", type=int, default=5)
    p.add_argument("--limit", type=int, help="evaluate the first so many questions only")
    p.add_argument("--embed-url", default=env("EMBED_URL"), help="address of an embedding service; without it words are hashed")
    p.add_argument("--embed-model", default=env("EMBED_MODEL"))
    p.add_argument("--chat-url", default=env("CHAT_URL"))
    p.add_argument("--chat-model", default=env("CHAT_MODEL"), help="models asked in turn, by commas")
    p.add_argument("--key", default=env("KEY"), help="key of the services; better given as SKERRY_KEY")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    p = options()
    a = p.parse_args(argv)
    if not (a.data and a.out):
        p.error("--data and --out are needed")
    spark = spark or SparkSession.builder.appName("skerry").getOrCreate()
    COMMANDS[a.command](spark, a)
    release(spark)


if __name__ == "__main__":
    main()
