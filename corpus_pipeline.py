"""A corpus pipeline of five stages: filter toxic texts, drop exact and near copies, mix sources, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.  A stage's rows are to be stored before the next stage is called, as the tables that it wrote
on its way are deleted then.  ``run`` stores them in the shared folder and deletes what a stage has read.

Null and empty texts are documents like others: not toxic, copies of one another in the exact stage, without
shingles in the near one.  Rows with a null id stay apart: a copy of another row goes, otherwise the row stays; it is never
joined with near copies, and is repeated by a draw from its text.  Rows that repeat an id with equal texts are copies;
with other texts they are documents of their own.  Further columns ride along; the names that ``mixing`` reserves
for its helpers are refused.  Empty tables give empty results.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, exact_dedup, mixing, ngram_join, toxicity


def _stage(work):
    """A stage that first deletes the tables which the stage before it left, and owns those that it writes."""
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, _RUN)
        with common.scope(_RUN):
            return work(spark, docs, sf_dir)

    return run


_RUN = "pipeline"


def _without(docs: DataFrame, rows: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs whose id (null or not) and digest are not in the narrow table rows (broadcast only if its checked count is small)."""
    gone = common.written(rows, "dropped").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (digest == gone["__digest"])
    return docs.join(common.small(gone), same, "left_anti")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the training fold and keep the documents that score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, toxicity.training_rows())
    others = tuple(c for c in docs.columns if c != "text")
    scored = toxicity.score(docs, model, keep=(*others, "text"))
    return scored.where(F.col("tox_score") < toxicity.THRESHOLD).select(*docs.columns)


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, with the smallest id, of each group of equal texts."""
    found = common.written(exact_dedup.decide(docs), "dedup-found")
    kept = _without(docs, exact_dedup.dropped(found), exact_dedup.text_digest("text"))
    again = common.written(exact_dedup.repeated(found), "repeated")
    if again.isEmpty():
        return kept
    # rows that repeat id and text are put together, partition by partition before they move; all others stay where they are
    again = common.small(again.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")))
    same = kept["doc_id"].eqNullSafe(again["__id"]) & (exact_dedup.text_digest("text") == again["__digest"])
    once = kept.join(again, same).dropDuplicates(["__id", "__digest"]).select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(once)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a shingle similarity of 0.8 or more."""
    return _without(docs, ngram_join.dropped_rows(docs), ngram_join.text_digest("text"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources have smoothed shares, in a globally shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


@_stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row for each copy."""
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Scores, shingles and token ids cannot be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with common.scope(f"pipeline-rows-{uuid.uuid4().hex}"):
            kept = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            common.discard(last)
        docs = last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
