"""Keep a term index over documents that go on arriving.

    python -m jobs.index_documents --documents PATH --index PATH --checkpoint PATH [--config jobs/index_documents.json]

A file stream takes the Parquet files that its checkpoint has not seen (``availableNow``: it ends when there are no
more).  Each batch becomes a segment of the index, a Parquet table partitioned by segment and bucket of the term; the
segment has the batch's number, so a batch that is repeated after a failure replaces its own files.  A document that
arrives again replaces what was known of it; a null text takes its words away.  Of rows that repeat an id in one batch
the one from the newest file counts, then the one with the greatest text hash.  Rows without an id are left out and counted in the log.
Running again over the same files changes nothing.

Retrieval over the index: ``tessera.operators.stored.index`` and ``search.bm25``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.operators import search, shared, stored

CONFIG = {"id": "doc_id", "text": "text", "title": ["source", "lang"], "buckets": stored.BUCKETS, "files_per_batch": 256}
log = common.logger("jobs.index_documents")


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, config: dict | None = None) -> dict:
    """Index what is new; returns how many batches, documents and postings this run wrote."""
    config = CONFIG | (config or {})
    done = {"batches": 0, "rows": 0, "without_id": 0, "documents": 0, "postings": 0}
    columns = list(dict.fromkeys([config["id"], config["text"], *config["title"]]))

    def batch(rows: DataFrame, number: int) -> None:
        segment = f"{number:012d}"
        n = rows.select(F.count("*").alias("n"), F.count(config["id"]).alias("with_id")).first()
        newest = F.struct("__at", F.xxhash64(config["text"]), config["text"])
        with shared.released(rows.sparkSession):
            docs = common.as_symbols(common.once(rows, config["id"], newest), config)
            stored.write(search.documents(docs), index, segment, buckets=config["buckets"])
        held = stored.table(rows.sparkSession, index, [segment]).groupBy((F.col("bucket") == stored.HELD).alias("held")).count()
        counts = {r.held: r["count"] for r in held.collect()}
        wrote = {"batches": 1, "rows": n.n, "without_id": n.n - n.with_id, "documents": counts.get(True, 0), "postings": counts.get(False, 0)}
        for name, value in wrote.items():
            done[name] += value
        log.info("batch %d: read %d rows of %s (%d without an id), wrote %d documents and %d postings to %s/segment=%s", number, n.n, documents, n.n - n.with_id, wrote["documents"], wrote["postings"], index, segment)

    # a pattern that names this very path lets the stream take a folder of files and a single file alike
    path = documents.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    schema = spark.read.parquet(documents).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern).select(*columns, F.col("_metadata.file_modification_time").alias("__at"))
    query = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("done: %s", done)
    return done


def postings(spark: SparkSession, index: str) -> DataFrame:
    """(id, term, dl, tf_identity, tf_body): the index as it stands."""
    return stored.live(stored.table(spark, index)).select("id", "term", "dl", "tf_identity", "tf_body")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "index", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        run(spark, given.documents, given.index, given.checkpoint, common.configuration(spark, given.config) if given.config else None)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
