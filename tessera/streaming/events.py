"""Event logs and receipts as streams (an extension: the batch operators do the same on whole tables)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas


def read_hook_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    rows = spark.readStream.schema(schemas.HOOK_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("schema_version = 1").withColumn("ts", F.to_timestamp("timestamp"))


def activation_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and mean latency by window, host and activation; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "host", "activation").agg(F.count("*").alias("n"), F.avg("elapsed_ms").alias("mean_ms"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "host").agg(F.count("*").alias("n"))


def live_receipts(receipts: DataFrame, ttl: float = 86_400, keep: int = 100) -> DataFrame:
    """Receipts (workspace, key, created) of a stream that are still known: (workspace, version, key, created), all of a
    workspace anew under a higher version whenever a batch has receipts of it.  ``current`` takes the last of them.

    A receipt ends ``ttl`` seconds before the newest of its workspace, or when ``keep`` newer ones are there (by time, then
    key), as ``incremental.evict`` has it.  One that comes again counts with its latest time; one that comes late may be
    over at once.  The state of a workspace is at most ``keep`` receipts, however many rows a batch has: they are read
    in Arrow batches and cut each time.  A null time counts as the epoch; rows without workspace or key are no receipts.
    """
    rows = receipts.where("workspace is not null and key is not null").select("workspace", "key", F.coalesce(F.unix_micros("created"), F.lit(0)).alias("created"))
    span = round(ttl * 1_000_000)

    def known(by: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, keys, times = state.get if state.exists else (0, [], [])
        live = pd.Series(list(times), index=list(keys), dtype="int64")
        for batch in batches:
            live = pd.concat([live, batch.set_index("key")["created"]]).groupby(level=0).max()
            order = pd.DataFrame({"created": live.to_numpy(), "key": live.index}).sort_values(["created", "key"]).tail(keep)
            order = order[order["created"] >= order["created"].max() - span]
            live = pd.Series(order["created"].to_numpy(), index=order["key"].to_numpy(), dtype="int64")
        state.update((version + 1, live.index.tolist(), live.tolist()))
        yield pd.DataFrame({"workspace": by[0], "version": version + 1, "key": live.index, "created": live.to_numpy()})

    shape = "workspace string, version long, key string, created long"
    out = rows.groupBy("workspace").applyInPandasWithState(known, shape, "version long, keys array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("created", F.timestamp_micros("created"))


def current(written: DataFrame) -> DataFrame:
    """(workspace, key, created): what a stored stream of ``live_receipts`` knows after its last batch."""
    last = written.groupBy("workspace").agg(F.max("version").alias("version"))
    return written.join(last, ["workspace", "version"]).select("workspace", "key", "created")


def changed_files(spark: SparkSession, root: str, suffixes: str = "*.py") -> DataFrame:
    """New files of a tree as they arrive, with content and hash."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(root)
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), "modificationTime", "content")
