"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of blanks becomes one space; null counts as empty.  The first pass
reads lengths and prefix hashes and pre-aggregates them before its only shuffle; groups of one are settled there.
The full hash is computed only for rows of surviving groups.  A hot group is one aggregated row; where its members
are joined back, the join's exchanges are plain, so adaptive execution can split them.

Rows that repeat a doc_id with an equal text all get the same decision, and group_size counts each of them.  Null
ids are allowed and lose against any other id.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAP_WORDS = 1 << 17  # numbers of 64 bits in the map of surviving keys: 1 MB
PREFIX = 64  # characters of the normalised text that the prefix hash reads


def normalised(text: str):
    return F.regexp_replace(common.whole(text), common.WHITE, " ")


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(text_col), 256))


def _place() -> tuple[Column, Column]:
    """Where a key's bit stands: the number's place and its bit."""
    h = F.xxhash64("len", "pre")
    return F.pmod(h, F.lit(MAP_WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(len, pre) div {MAP_WORDS}, 64) as int))")


def bit_map(keys: DataFrame) -> DataFrame:
    """One row with the bits that the keys set, as MAP_WORDS numbers of 64 bits; pre-aggregated, so its size is fixed."""
    word, bit = _place()
    held = keys.select(word.alias("word"), bit.alias("bit")).unionByName(keys.sparkSession.range(MAP_WORDS).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit")))
    words = held.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("words"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """``id, size, keep`` for the rows of groups of two or more; all other rows stay as they are.

    The surviving (length, prefix hash) keys go to the readers, and full hashes are taken from survivors alone: the
    keys themselves if they are few enough (the count is checked), else a bit map of fixed size that they set; what
    passes the map by chance is taken out by an exact join of narrow rows.  No text is shuffled.
    """
    common.bounded_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    keyed = text.select("id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("pre"))
    groups = common.written(keyed.groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1").select("len", "pre"), "dedup-groups")
    full = F.sha2(F.col("norm"), 256).alias("full")
    if groups.limit(broadcast_rows + 1).count() <= broadcast_rows:
        alive = keyed.join(F.broadcast(groups), ["len", "pre"], "left_semi").select("id", full)
    else:
        bits = common.written(bit_map(groups), "dedup-bits")
        word, bit = _place()
        maybe = keyed.join(F.broadcast(bits)).where(F.get("words", word).bitwiseAND(bit) != 0)  # one row of MAP_WORDS numbers
        alive = maybe.select("id", "len", "pre", full).join(groups, ["len", "pre"], "left_semi").select("id", "full")
    alive = common.written(alive, "dedup-alive")
    classes = alive.groupBy("full").agg(F.count("*").alias("size"), F.min("id").alias("keep")).where("size > 1")
    # a table of its own, so that both sides of the join have plain exchanges, which adaptive execution can split
    classes = common.small(common.written(classes, "dedup-classes"), broadcast_rows)
    return alive.join(classes, "full").select("id", "full", "size", "keep")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Decisions meet the rows on (id, digest): a doc_id that repeats with another text is another document.
    """
    found = decide(docs, id_col, text_col, **limits).distinct()
    rows = docs.select(F.col(id_col).alias("rid"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    same = F.col("rid").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("full"))
    return rows.join(found, same, "left").select(
        F.col("rid").alias(id_col),
        F.coalesce("keep", "rid").alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("keep").isNull() | F.col("keep").eqNullSafe(F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def dropped(found: DataFrame) -> DataFrame:
    """``id, digest`` of the rows that go by the decisions of ``decide``, null ids included; ``digest`` is ``text_digest``."""
    gone = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id"))
    return found.where(gone).select("id", F.unhex("full").alias("digest")).distinct()


def repeated(found: DataFrame) -> DataFrame:
    """``id, digest`` of the rows that stay and occur more than once with one id (or with none) and one text."""
    stays = found.where(F.col("keep").eqNullSafe(F.col("id"))).groupBy("id", "full").agg(F.count("*").alias("n"))
    return stays.where("n > 1").select("id", F.unhex("full").alias("digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
