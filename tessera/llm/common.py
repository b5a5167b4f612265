"""Shared helpers: the folder all executors see, written tables, size-checked joins, hot-key splitting."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of a narrow table (a few dozen bytes each) up to which it may be broadcast: about 16 MB.
BROADCAST_ROWS = 200_000
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of a word that a worker remembers the hash of; longer ones would let a cache of so many words fill a worker.
SHORT = 32

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: (application, path, scope) of the tables written and not yet deleted.
_written: list[tuple[str, str, str]] = []
_scopes: list[str] = [""]
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one of this machine, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own_dir[0].removeprefix("file://"), ignore_errors=True)
    return _own_dir[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives executors.

    What was shuffled for it goes with the end of the write; on its own, Spark keeps such files until the driver's
    garbage is collected, which may be after the disks are full.  ``df`` is not to be used again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark.sparkContext.applicationId, path, _scopes[-1]))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def scope(name: str):
    """Tables written inside belong to the named run; nested scopes stand for themselves."""
    _scopes.append(name)
    try:
        yield
    finally:
        _scopes.pop()


def _delete(spark: SparkSession, items: list[tuple[str, str, str]]) -> None:
    for item in items:
        path = spark._jvm.org.apache.hadoop.fs.Path(item[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(item)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, [x for x in _written if x[1] == table._stored_at])


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of a named run; only once every result that reads them is stored.  Those of others stay."""
    app = spark.sparkContext.applicationId
    _delete(spark, [x for x in _written if x[0] == app and x[2] == name])


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of texts small: readers decode 256 rows at a time, and an Arrow batch holds 256 rows or 4 MB, so very
    long texts fill neither an executor's heap nor a worker.  The workers get this package as well."""
    ship(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored narrow table for broadcast if it has few enough rows; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def trimmed(batches):
    """The batches of a task; then give back to the system what a worker kept, as it lives on for other stages."""
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_fold(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two columns of one orderable type.  Returns ``node, component`` (smallest node reachable) for every node of
    an edge.  Each step is two joins on node ids with an aggregate, so a hub's links are pre-aggregated; the
    aggregate is dealt anew before its join, so that both sides have plain exchanges and adaptive execution can
    split a hub's rows.  The edge table is written each round.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    # a row is two numbers: an eighth of the tasks writes as well, and leaves an eighth of the files
    files = max(1, partitions(edges.sparkSession) // 8)
    now = written(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).coalesce(files), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")).repartition(F.xxhash64("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.repartition(F.xxhash64("u", "m")), "u")
        nxt = tidy(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        now = written(nxt.coalesce(files), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (state.n, state.h):
            break
        seen = (state.n, state.h)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def runs(batches, width: int):
    """Groups of consecutive rows that agree in their first ``width`` columns, each as a list of columns.

    The input is sorted by those columns; a group may span batches.  Far cheaper than one pandas call per group.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []

    def columns(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]

    def key(batch, i):
        return tuple(batch.column(c)[i].as_py() for c in range(width))

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in range(width)]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(starts, starts[1:]):
            now = key(b, i)
            if held and now != last:
                yield last, columns(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield last, columns(held)
