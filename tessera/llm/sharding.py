"""Sharding along a Hilbert curve.

Language, size and source are quantised to 16 steps each; rows are sorted by the curve's index of their cell, then
by a hash and the id, and the sorted run is cut into shards of equal row counts (law ``rows``: at most one apart).
Languages and sources are quantised in the order of their names, by the rows that stand before them, so a step is a
range of names.  Neighbours on the curve differ by one step in one dimension, so each shard's file covers a compact box of
the metadata space and readers can prune by the minimum and maximum of any of the three.

Texts are read once, into a table of narrow rows.  The sort is a range exchange of these; only the row counts of its
partitions (one number each) are summed up to turn places within partitions into global ones.  Null texts have 0 bytes;
null sources and languages are a step of their own; a hot cell is spread by the hash, and rows with a null id by the
hash of their text.  Repeated rows each take a place.  Empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
BITS, DIMS = 4, 3


def curve_index(point: list[int], bits: int = BITS) -> int:
    """Index of a point on the Hilbert curve through a cube with 2**bits steps a side.

    Walks from the largest sub-cube to the smallest.  In each, the sub-cube's Gray-code rank gives the next digits;
    the entry corner and main direction of the walk inside are carried along.
    """
    n = len(point)
    mask = (1 << n) - 1
    turn = lambda v, k: ((v >> k % n) | (v << (n - k % n))) & mask
    entry, axis, index = 0, 0, 0
    for bit in range(bits - 1, -1, -1):
        corner = sum((x >> bit & 1) << i for i, x in enumerate(point))
        seen = turn(corner ^ entry, axis + 1)
        rank, g = 0, seen
        while g:
            rank, g = rank ^ g, g >> 1
        index = index << n | rank
        gray = lambda i: i ^ i >> 1
        into = 0 if rank == 0 else gray(2 * ((rank - 1) // 2))
        entry ^= turn(into, n - (axis + 1) % n)
        step = 0 if rank == 0 else (rank if rank % 2 else rank - 1)
        ones = 0
        while step & 1:
            ones, step = ones + 1, step >> 1
        axis = (axis + (ones % n if rank else 0) + 1) % n
    return index


def curve_table(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Curve index of every cell; cell number: the steps of the dimensions as digits, first dimension highest."""
    side = 1 << bits
    return [curve_index([cell // side**d % side for d in range(dims - 1, -1, -1)], bits) for cell in range(side**dims)]


def _running(rows: DataFrame, order: list[str], weight: Column, parts: int, label: str) -> DataFrame:
    """Rows with ``__before``, the weights of all rows ahead in the order, and ``__total``: a range exchange, sums within
    partitions, and one number for each of the ``parts`` partitions."""
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sorted_rows = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).withColumn("__w", weight.cast("long"))
    placed = common.written(sorted_rows.withColumn("__ahead", F.coalesce(F.sum("__w").over(inside), F.lit(0))), label)
    sums = placed.groupBy("__part").agg(F.sum("__w").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__part", ahead.alias("__offset"), F.sum("n").over(Window.partitionBy()).alias("__total"))
    return placed.join(F.broadcast(offsets), "__part").withColumn("__before", F.col("__ahead") + F.col("__offset")).drop("__part", "__w", "__ahead", "__offset")


def name_steps(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """``column, step``: 1 to 15 in the order of names, each name by the middle of its rows."""
    names = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    run = _running(names, [column], F.col("n"), parts, f"shard-{column}")
    return run.select(column, F.expr("1 + (15 * (2 * __before + n)) div (2 * __total)").cast("int").alias(f"{column}_step"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``id, size, text_crc32, cell, curve, shard, slot`` for every row of ``docs``."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    parts = common.partitions(spark)
    text = common.whole(text_col)
    tie = F.md5(F.coalesce(F.col(id_col).cast("string"), text).cast("binary"))
    narrow = common.written(
        docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tie.alias("tie"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang")),
        "shard-rows",
    )
    for column in ("lang", "source"):
        narrow = narrow.join(common.small(common.written(name_steps(narrow, column, parts), f"shard-{column}-steps")), column, "left")
    # two bits of length over 16 share the last step
    size_step = F.least(F.lit(15), F.greatest(F.lit(0), F.length(F.bin("size")) - 5))
    table = F.array(*(F.lit(i) for i in curve_table()))
    cell = F.coalesce("lang_step", F.lit(0)) * 256 + size_step * 16 + F.coalesce("source_step", F.lit(0))
    narrow = narrow.withColumn("cell", cell).select("id", "size", "text_crc32", "cell", F.element_at(table, F.col("cell") + 1).alias("curve"), "tie")
    order = ["curve", "tie", "id", "size", "text_crc32"]
    placed = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = common.written(placed.drop("tie"), "shard-places")
    # one row a partition: as many as the session's shuffle partitions, whatever the input
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("at")
    base, extra = F.expr(f"total div {shards}"), F.expr(f"total % {shards}")
    longer = extra * (base + 1)
    ranked = placed.join(F.broadcast(before), "part").withColumn("rank", rank)
    first = F.col("rank") < longer
    safe = F.greatest(base, F.lit(1))
    return ranked.select(
        "id", "size", "text_crc32", "cell", "curve",
        F.when(first, F.floor(F.col("rank") / (base + 1))).otherwise(extra + F.floor((F.col("rank") - longer) / safe)).cast("int").alias("shard"),
        F.when(first, F.col("rank") % (base + 1)).otherwise((F.col("rank") - longer) % safe).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_rows() -> list[int]:
    """The table of the reflected polynomial EDB88320, by its rule."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


def _crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST(('0x' || h) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda a, b: xor(a >> 8, crc_rows[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


def _steps_sql(column: str) -> str:
    return f"SELECT {column}, 1 + (15 * (2 * coalesce(sum(n) OVER (ORDER BY {column} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n)) // (2 * sum(n) OVER ()) AS step FROM (SELECT {column}, count(*) AS n FROM documents WHERE {column} IS NOT NULL GROUP BY {column})"


ORACLE = f"""
WITH c AS (SELECT {_crc_rows()}::BIGINT[] AS crc_rows, {curve_table()}::INTEGER[] AS curve_rows),
l AS ({_steps_sql("lang")}),
s AS ({_steps_sql("source")}),
d AS (SELECT doc_id, lang, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, c),
p AS (SELECT d.doc_id, d.size, d.text_crc32, curve_rows[CAST(coalesce(l.step, 0) * 256 + least(15, greatest(0, length(bin(d.size)) - 5)) * 16 + coalesce(s.step, 0) + 1 AS BIGINT)] AS curve
  FROM d LEFT JOIN l ON d.lang = l.lang LEFT JOIN s ON d.source = s.source, c),
r AS (SELECT *, row_number() OVER (ORDER BY curve, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size, text_crc32) - 1 AS k, count(*) OVER () AS n FROM p),
b AS (SELECT *, n // {SHARDS} AS base, n % {SHARDS} AS extra FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law,
  CAST(CASE WHEN k < extra * (base + 1) THEN k // (base + 1) ELSE extra + (k - extra * (base + 1)) // greatest(base, 1) END AS INTEGER) AS shard,
  CASE WHEN k < extra * (base + 1) THEN k % (base + 1) ELSE (k - extra * (base + 1)) % greatest(base, 1) END AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM b
"""
