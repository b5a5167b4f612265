"""What both jobs do: arguments, configuration, and documents with one row an id."""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def logger(name: str) -> logging.Logger:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return logging.getLogger(name)


def configuration(spark: SparkSession, path: str) -> dict:
    """A small JSON file, read by Spark, since it may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def once(documents: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key: the one that is greatest by ``order``.  Null keys drop out.

    Only the rows of keys that repeat are shuffled; all others pass by a join with the repeated keys, which is a
    broadcast only if their count is small.
    """
    from tessera.operators import shared

    keyed = documents.where(F.col(key).isNotNull())
    twice = shared.written(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated-ids")
    twice = shared.small(twice)
    row = F.struct(*(F.col(c) for c in documents.columns))
    firsts = keyed.join(twice, key, "left_semi").groupBy(F.col(key).alias("__key")).agg(F.max_by(row, order).alias("row")).select("row.*")
    return keyed.join(twice, key, "left_anti").unionByName(firsts)


def as_symbols(documents: DataFrame, config: dict) -> DataFrame:
    """Documents in the shape that retrieval takes: the title columns are the identity, the text is the body."""
    title = F.concat_ws("/", *(F.col(c).cast("string") for c in config["title"]))
    return documents.select(F.col(config["id"]).cast("string").alias("id"), title.alias("name"), title.alias("qualname"), title.alias("path"), F.lit(False).alias("is_test"), F.col(config["text"]).alias("source"))
