"""Transactions of edits on a source tree: begin, update, verify, record tests, roll back or commit.

The state is a folder of the index: one file that says which transaction is active (created once, so there is one at
a time), and a log of Parquet tables, one for each update, with every file's content before and after.  The log is written
before any file, so whatever happens in between, the content before is at hand.  A file counts as changed from
outside if its content is none of those in the log.
"""

from __future__ import annotations

import difflib
import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import shared, stats
from ..sources import python_parser, scan
from . import snapshot
from .snapshot import Conflict, Store

LOG = "seq int, path string, before binary, hash_before string, content binary, hash_after string"
BATCH = 1000  # files of one update, at most: they pass through the driver on their way to the tree


def last_states(log: DataFrame) -> DataFrame:
    """(path, before, hash_before, hash_after, hashes): what each file was before the transaction, what the last update
    made of it, and every content that the transaction knows of."""
    each = log.groupBy("path").agg(
        F.min_by("before", "seq").alias("before"), F.min_by("hash_before", "seq").alias("hash_before"), F.max_by("hash_after", "seq").alias("hash_after"),
        F.array_sort(F.array_distinct(F.concat(F.collect_list("hash_before"), F.collect_list("hash_after")))).alias("hashes"),
    )
    return each


def outside_changes(log: DataFrame, now: DataFrame) -> DataFrame:
    """(path): files of the log whose present content (path, hash) is in none of its rows."""
    met = last_states(log).join(now.select("path", F.col("hash").alias("hash_now")), "path", "left")
    return met.where(~F.coalesce(F.array_contains("hashes", F.col("hash_now")), F.lit(False))).select("path")


class Transactions:
    def __init__(self, store: Store, root: str):
        self.store, self.spark, self.root = store, store.spark, root.rstrip("/")

    # ---- state

    def _path(self, name: str):
        return self.store._at(f"transactions/{name}")

    def _write(self, name: str, value: dict, replace: bool = True) -> None:
        path, fs = self._path(name)
        out = fs.create(path, replace)
        out.write(json.dumps(value).encode())
        out.close()

    def active(self) -> dict:
        path, fs = self._path("active.json")
        value = self.store._read(path) if fs.exists(path) else None
        if value is None:
            raise Conflict("no transaction is active")
        return value

    def begin(self) -> dict:
        if self.store.manifest() is None:
            raise ValueError("index the tree first")
        tx = {"transaction": uuid.uuid4().hex, "started": time.time(), "updates": 0, "tests": None}
        try:
            self._write("active.json", tx, replace=False)
        except Exception as error:  # noqa: BLE001  the file system's own error
            raise Conflict("a transaction is already active") from error
        return {"transaction": tx["transaction"], "status": "active"}

    def log(self) -> DataFrame:
        tx = self.active()
        paths = [f"{self.store.path}/transactions/{tx['transaction']}/{n}" for n in range(tx["updates"])]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def files(self) -> DataFrame:
        return scan.files(self.spark, self.root)

    def fingerprint(self) -> str:
        return stats.fingerprint_tree(self.files(), schemas.SCHEMA_VERSION).first().fingerprint

    # ---- edits

    def update(self, changes: DataFrame, dry_run: bool = True) -> DataFrame:
        """(id, path, ok, error, diff) of changes (id, expected_hash, source); without ``dry_run`` they are applied, if all
        of them are good."""
        files = shared.written(self.files().select("path", "hash", "content"), "tx-files")
        done = shared.written(snapshot.edits(files, self.store.table("symbols").where("not analysis_stale"), changes), "tx-edits")
        out = done.select("id", "path", "ok", "error", "diff")
        if dry_run:
            return out
        tx = self.active()
        if done.where("not ok").count() or done.count() != changes.count():
            raise Conflict("not every change can be applied")
        shared.require(done.count() <= BATCH and done.count() == done.select("path").distinct().count(), f"an update takes at most {BATCH} changes, one a file")
        self._check_conflicts()
        entry = done.join(files.select("path", F.col("content").alias("before"), F.col("hash").alias("hash_before")), "path")
        entry = entry.select(F.lit(tx["updates"]).alias("seq"), "path", "before", "hash_before", "content", F.sha2("content", 256).alias("hash_after"))
        # the log first, then the count of updates that makes it known, then the files
        where = f"{self.store.path}/transactions/{tx['transaction']}/{tx['updates']}"
        entry.write.mode("overwrite").parquet(where)
        self._write("active.json", tx | {"updates": tx["updates"] + 1, "tests": None})
        for r in self.spark.read.parquet(where).select("path", "content").toLocalIterator():
            self._put(r.path, bytes(r.content))
        self.store.build(self.root)
        return out

    def _put(self, relative: str, content: bytes) -> None:
        """Replace a file of the tree by way of a file beside it."""
        conf, Path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path
        target = Path(self.root if "://" in self.root else f"file://{self.root}", relative)
        fs = target.getFileSystem(conf)
        beside = Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
        fs.setWriteChecksum(False)  # a checksum beside a source would outlive its next change by an editor
        try:
            out = fs.create(beside, True)
            out.write(content)
            out.close()
        finally:
            fs.setWriteChecksum(True)
        if not fs.rename(beside, target):  # some file systems do not rename onto a file
            fs.delete(target, False)
            fs.rename(beside, target)

    def _check_conflicts(self) -> None:
        changed = [r.path for r in outside_changes(self.log(), self.files().select("path", "hash")).orderBy("path").limit(10).collect()]
        if changed:
            raise Conflict(f"changed from outside: {', '.join(changed)}")

    def diff(self) -> DataFrame:
        """(path, diff) between the content before the transaction and the present one."""
        def run(batches):
            import pandas as pd

            for pdf in batches:
                sides = [(r.path, *(python_parser.text_of(bytes(x)).splitlines(True) for x in (r.before, r.content))) for r in pdf.itertuples()]
                yield pd.DataFrame([(p, "".join(difflib.unified_diff(a, b, p, p))) for p, a, b in sides], columns=["path", "diff"])

        return last_states(self.log()).select("path", "before").join(self.files().select("path", "content"), "path").mapInPandas(run, "path string, diff string")

    # ---- ends

    def verify(self) -> dict:
        """Parse the whole tree anew; Python files that do not parse block a commit."""
        files = self.files()
        found = python_parser.diagnostics(python_parser.parse(files)).where("language = 'python'").orderBy("path").limit(100).collect()
        return {"ok": not found, "files": files.count(), "diagnostics": [r.asDict() for r in found]}

    def record_tests(self, ok: bool) -> dict:
        """The caller's own test run on the present tree; its code is never run here."""
        tx = self.active()
        tests = {"ok": ok, "fingerprint": self.fingerprint()}
        self._write("active.json", tx | {"tests": tests})
        return tests

    def _end(self, status: str) -> dict:
        tx = self.active()
        self._write(f"history-{tx['transaction']}.json", tx | {"status": status, "ended": time.time()})
        path, fs = self._path("active.json")
        fs.delete(path, False)
        self.store.build(self.root)
        return {"transaction": tx["transaction"], "status": status}

    def rollback(self) -> dict:
        self._check_conflicts()
        for r in last_states(self.log()).select("path", "before").toLocalIterator():
            self._put(r.path, bytes(r.before))
        return self._end("rolled_back")

    def commit(self) -> dict:
        tests = self.active()["tests"]
        self._check_conflicts()
        if not self.verify()["ok"]:
            raise Conflict("the tree does not parse: mend it or roll back")
        if not tests or not tests["ok"] or tests["fingerprint"] != self.fingerprint():
            raise Conflict("record passing tests of the present tree first")
        return self._end("committed")
