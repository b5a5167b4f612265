"""Helpers that several operators need."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it may be broadcast, about 16 MB.
BROADCAST_ROWS = 200_000
_own: list[str] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; where none is set, a temporary one of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
    return _own[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: cuts lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Tables of ``written`` that this thread writes inside are deleted at the end; what is read from them must be stored by
    then."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table if its counted rows are few; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by a key over as many tasks as shuffles have, before costly work on each row; a number that is given is
    not lessened by adaptive execution."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def top(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark cuts groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)
