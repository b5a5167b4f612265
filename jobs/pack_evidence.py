"""Pack the evidence for a batch of tasks: the best documents of each that fit a budget of bytes.

    python -m jobs.pack_evidence --tasks PATH --documents PATH --output PATH [--config jobs/pack_evidence.json]

Documents are ranked for each task by BM25; from the best on, every document that still fits is taken into the pack.
The output is Parquet, partitioned by the task's intent, with one row for each ranked document: taken ones carry their
text.  Rows without an id drop out; of rows that repeat an id the one with the greatest text hash counts.  Running
again replaces the output by the same rows.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions import text
from tessera.operators import pack, search, shared

CONFIG = {"task_id": "item_id", "task_text": "text", "id": "doc_id", "text": "text", "title": ["source", "lang"], "limit": 20, "budget": 20_000}
SCHEMA = "task_id {kind}, id string, score double, rank int, bytes int, included boolean, text string, intent string"
log = common.logger("jobs.pack_evidence")


def packs(tasks: DataFrame, documents: DataFrame, config: dict) -> DataFrame:
    """(task_id, id, score, rank, bytes, included, text, intent) for tasks and documents with the configured columns."""
    hashed = lambda c: F.struct(F.xxhash64(c), F.col(c))
    own = common.once(tasks.select(F.col(config["task_id"]).alias("task_id"), F.col(config["task_text"]).alias("text")), "task_id", hashed("text"))
    own = shared.written(own.withColumn("text", F.coalesce("text", F.lit(""))), "tasks")
    columns = list(dict.fromkeys([config["id"], config["text"], *config["title"]]))
    docs = common.as_symbols(common.once(documents.select(*columns), config["id"], hashed(config["text"])), config)
    ranked = shared.written(search.bm25(own, search.documents(docs), config["limit"]), "ranked")
    # texts are read again for ranked documents only
    wanted = shared.small(ranked.select("id").distinct())
    texts = docs.join(wanted, "id", "left_semi").select("id", F.coalesce("source", F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text"))
    found = shared.written(ranked.join(texts, "id"), "ranked-texts")
    taken = pack.first_fit(found, config["budget"], ["rank"])
    out = found.join(taken, ["task_id", "id"]).join(shared.small(own.select("task_id", text.intent(F.col("text")).alias("intent"))), "task_id")
    return out.select("task_id", "id", "score", "rank", "bytes", "included", F.when(F.col("included"), F.col("text")).alias("text"), "intent")


def run(spark: SparkSession, tasks: str, documents: str, output: str, config: dict | None = None) -> dict:
    """Write the packs; returns how many tasks and documents were read and rows written."""
    config = CONFIG | (config or {})
    asked, docs = spark.read.parquet(tasks), spark.read.parquet(documents)
    with shared.released(spark):
        packs(asked, docs, config).write.mode("overwrite").partitionBy("intent").parquet(output)
    done = {"tasks": asked.count(), "documents": docs.count()}
    n = read(spark, output, asked.schema[config["task_id"]].dataType.simpleString()).agg(F.count("*").alias("rows"), F.countDistinct("task_id").alias("packs"), F.coalesce(F.sum(F.when(F.col("included"), F.col("bytes"))), F.lit(0)).alias("bytes")).first()
    done |= n.asDict()
    log.info("read %d tasks of %s and %d documents of %s; wrote %d rows in %d packs with %d bytes of evidence to %s", done["tasks"], tasks, done["documents"], documents, n["rows"], n.packs, n.bytes, output)
    return done


def read(spark: SparkSession, output: str, task_type: str = "long") -> DataFrame:
    """The packs; an output without any row is an empty table."""
    return spark.read.schema(SCHEMA.format(kind=task_type)).parquet(output)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("tasks", "documents", "output"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = SparkSession.builder.appName("pack_evidence").getOrCreate()
    try:
        run(spark, given.tasks, given.documents, given.output, common.configuration(spark, given.config) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
