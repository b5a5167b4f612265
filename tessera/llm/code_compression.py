"""Compression of vectors to part codes: Lloyd's rounds with heaps of slacks (product quantisation by heap Lloyd).

A vector is cut into equal consecutive parts, and each part position has a codebook of its own.  The first assignment
measures every part against every entry and keeps how much nearer its entry is than the second: lower minus upper
bound, the slack.  Vectors stand in blocks; in a block, each entry of each position has a heap of its parts, keyed by
slack plus the entry's cumulative drift when the part was pushed.  After entries move, a later assignment pops only parts
whose key the entry's cumulative drift (its own way plus the longest of any other) has reached; those are
measured exactly against all entries and pushed again.  All other parts provably keep their entry, and are not
touched.  A heap is stored as a sorted run, whose violated parts are a prefix.  Bounds carry a margin for rounding, and
distances are whole numbers, so codes are those of the plain rounds.

Blocks, heaps included, are a written table each round, so a lost executor repeats one step.  Sums travel as
differences of parts that changed their entry, summed by Spark; the driver holds the codebooks and their sums alone
(entries x components numbers).

Rows whose vector is null or holds null or non-finite components are dropped.  Vectors shorter than the longest are
filled with zeros at the end, as is a length that the number of parts does not divide; an empty vector is all zeros.
First entries are the first rows by id, then vector; null ids come last.  Fewer rows than entries give as many entries as
rows.  Rows that repeat an id each count and each give a row.  Components beyond the magnitude at which an error fits 64
bits (about 2**30 / sqrt(length)) stand for that magnitude.  Null labels count as one label.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 1 << 18  # components of a block
MARGIN = 1e-9  # relative; far above what rounding of square roots and sums of drifts can add up to

STATE = "x binary, code binary, heap binary, place binary, sums array<long>, counts array<long>"


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def whole_numbers(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * scale), -limit, limit).astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts to entries; through floats where every intermediate value is a whole number below 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index), and its slack: how much farther the second nearest is."""
    d = distances(x, entries)
    code = d.argmin(1)
    if d.shape[1] == 1:
        return code, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, 1)[:, :2].astype(np.float64))
    return code, two[:, 1] * (1 - MARGIN) - two[:, 0] * (1 + MARGIN)


class Block:
    """Vectors of one block as whole numbers, their codes, and the heaps: for each position, places ordered by entry and key."""

    def __init__(self, x: np.ndarray, code: np.ndarray, heap: np.ndarray, place: np.ndarray):
        self.x, self.code, self.heap, self.place = x, code, heap, place  # n x parts x width; n x parts; parts x n; parts x n

    @classmethod
    def first(cls, x: np.ndarray, books: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
        n, parts = x.shape[:2]
        block = cls(x, np.zeros((n, parts), np.uint8), np.zeros((parts, n)), np.tile(np.arange(n, dtype=np.int32), (parts, 1)))
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for p in range(parts):
            code, key = nearest(x[:, p], books[p])
            block._order(p, code, key, np.arange(n, dtype=np.int32))
            np.add.at(sums[p], code, x[:, p])
            counts[p] = np.bincount(code, minlength=books.shape[1])
        return block, sums, counts

    def _order(self, p: int, code: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        self.code[place, p] = code
        by = np.lexsort((key, code))
        self.heap[p], self.place[p] = key[by], place[by]

    def popped(self, p: int, drift: np.ndarray) -> np.ndarray:
        """Which slots of a position's heaps the drift has reached: a prefix of each entry's run."""
        ends = np.cumsum(np.bincount(self.code[:, p], minlength=len(drift)))
        out = np.zeros(len(self.x), bool)
        for entry, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
            if lo < hi and self.heap[p, lo] <= drift[entry]:
                out[lo : lo + np.searchsorted(self.heap[p, lo:hi], drift[entry], "right")] = True
        return out

    def advance(self, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop, measure and push again; returns how the sums and counts of entries change."""
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for p in range(len(books)):
            out = self.popped(p, drift[p])
            if not out.any():
                continue
            at = self.place[p, out]
            old = self.code[at, p].astype(np.int64)
            code, slack = nearest(self.x[at, p], books[p])
            moved = code != old
            for sign, entry in ((1, code[moved]), (-1, old[moved])):
                np.add.at(sums[p], entry, sign * self.x[at[moved], p])
                np.add.at(counts[p], entry, sign)
            stay = self.place[p, ~out]
            self._order(p, np.concatenate([self.code[stay, p], code]), np.concatenate([self.heap[p, ~out], slack + drift[p][code]]), np.concatenate([stay, at]))
        return sums, counts

    def errors(self, books: np.ndarray) -> np.ndarray:
        near = books[np.arange(len(books)), self.code]
        return ((self.x - near) ** 2).sum((1, 2))

    def columns(self, sums: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        raw = [pa.array([v.tobytes()], pa.binary()) for v in (self.x, self.code, self.heap, self.place)]
        return raw + [pa.array([v.ravel().tolist()], pa.list_(pa.int64())) for v in (sums, counts)]

    @classmethod
    def load(cls, batch: pa.RecordBatch, i: int, parts: int, width: int) -> Block:
        x, code, heap, place = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("x", np.int64), ("code", np.uint8), ("heap", np.float64), ("place", np.int32)))
        return cls(x.reshape(-1, parts, width), code.reshape(-1, parts).copy(), heap.reshape(parts, -1).copy(), place.reshape(parts, -1).copy())


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in blocks of at most so many."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, min(rows, batch.num_rows - at))
            if n + piece.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dense(vectors: pa.ListArray, dim: int, scale: int, limit: int) -> np.ndarray:
    x = np.zeros((len(vectors), dim), np.int64)
    n = vectors.value_lengths().to_numpy()
    x[np.arange(dim) < n[:, None]] = whole_numbers(vectors.flatten().to_numpy(), scale, limit)
    return x


def _added(blocks: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add the blocks' changes to the totals; Spark sums them by place before anything reaches the driver."""
    for column, total in (("sums", sums), ("counts", counts)):
        flat = total.reshape(-1)
        for r in blocks.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            flat[r["at"]] += int(r["v"])


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """``id_col, code, error, label_error, codebooks_sha256`` for every row kept, and the codebooks (parts x entries x width).

    At most 256 entries.
    """
    spark = table.sparkSession
    ship(spark)
    id_type, label_type = (table.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(finite("v"))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, code string, error long, label_error long, codebooks_sha256 string"), np.zeros((parts, 0, 0), object)
    width = max(1, -(-longest // parts))
    dim = width * parts
    limit = math.isqrt((1 << 60) // dim)
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.stack([_dense(pa.array([r.v], pa.list_(pa.float64())), dim, scale, limit).reshape(parts, width) for r in seeds], 1)
    some = max(1, block // dim)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, some):
            now, *change = Block.first(_dense(b.column(2), dim, scale, limit).reshape(-1, parts, width), books)
            ids, labels = (pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, *now.columns(*change)], names)

    schema = f"ids array<{id_type}>, labels array<{label_type}>, {STATE}"
    names = ["ids", "labels", *(c.split()[0] for c in STATE.split(", "))]
    table_of = common.written(rows.select("id", "label", "v").mapInArrow(lambda b: common.trimmed(started(b)), schema), "vec-blocks")
    drift, sums, counts = np.zeros(books.shape[:2]), np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    for turn in range(rounds):
        _added(table_of, sums, counts)
        books, drift = _moved(books, sums, counts, drift)
        if turn + 1 < rounds:
            before, table_of = table_of, common.written(table_of.mapInArrow(_step(books, drift, names), schema), "vec-blocks")
            common.discard(before)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                now = Block.load(b, i, parts, width)
                now.advance(books, drift * (1 + MARGIN))
                code = [row.tobytes().hex() for row in now.code]
                ids, labels = (b.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(now.errors(books))], ["id", "label", "code", "error"])

    final = table_of.drop("sums", "counts").mapInArrow(lambda b: common.trimmed(finished(b)), f"id {id_type}, label {label_type}, code string, error long")
    out = common.written(final, "vec-codes")
    common.discard(table_of)
    # a table of its own, so that a hot label's rows meet its sum through plain exchanges
    totals = common.written(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vec-errors")
    found = out.join(common.small(totals), F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")), books


def _moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floors of their parts' means (unused ones stay), and each entry's cumulative drift."""
    used = counts > 0
    new = books.copy()
    new[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
    way = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2))
    order = np.sort(way, 1)
    second = order[:, -2:-1] if order.shape[1] > 1 else np.zeros_like(order[:, :1])
    others = np.where(way == order[:, -1:], np.where((way == order[:, -1:]).sum(1, keepdims=True) > 1, order[:, -1:], second), order[:, -1:])
    return new, drift + way + others


def _step(books: np.ndarray, drift: np.ndarray, names: list[str]):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                now = Block.load(b, i, parts, width)
                change = now.advance(books, drift * (1 + MARGIN))
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1), b.column("labels").slice(i, 1), *now.columns(*change)], names)

    return lambda b: common.trimmed(run(b))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _oracle() -> str:
    nearest_sql = """a{n} AS (SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM px JOIN c{n} USING (p) GROUP BY r, p)"""
    moved_sql = """m{n} AS (SELECT p, best.e AS e, list_transform(range(1, (SELECT w FROM wide) + 1), lambda i: CAST(floor(list_sum(list_transform(list(x), lambda y: y[i])) / count(*)) AS BIGINT)) AS c
  FROM a{b} JOIN px USING (r, p) GROUP BY p, best.e),
c{n} AS (SELECT p, e, coalesce(m{n}.c, c{b}.c) AS c FROM c{b} LEFT JOIN m{n} USING (p, e))"""
    steps = [nearest_sql.format(n=0)]
    for n in range(1, ROUNDS + 1):
        steps += [moved_sql.format(n=n, b=n - 1), nearest_sql.format(n=n)]
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT CAST(ceil(max(len(v)) / {PARTS}) AS BIGINT) AS w FROM kept),
px AS (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, wide, range({PARTS}) t(p)),
c0 AS (SELECT p, r - 1 AS e, x AS c FROM px WHERE r <= {ENTRIES}),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
coded AS (SELECT r, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


ORACLE = _oracle()
