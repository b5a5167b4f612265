"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the mixture over its share of the corpus (in bytes).
A document's number of copies inverts the Poisson distribution with that mean at a number in [0, 1) drawn from a
hash of the seed and its id, so it is the same on every run and every cluster.  Documents are exploded by their
counts and shuffled globally: put in the order of a hash of seed, id and copy.

A null source is a source of its own, named ''.  Null texts have 0 bytes; a source without bytes keeps one copy of
each row unless its target is 0.  Rows that repeat an id draw the same count; a row with a null id draws by its text.
An empty table gives an empty result.  Other columns ride along; columns that are named like the helper columns
(``__copy``, ``__place``, ``__rate`` and so on) must be renamed before, which is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 17
SMOOTHING = 0.5  # default targets: share ** SMOOTHING, normalised
_UNIT = 16**13


def unit(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(_UNIT))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``src, bytes, rate``: one row for each source, aggregated before the shuffle."""
    sizes = docs.groupBy(F.coalesce(source_col, F.lit("")).alias("src")).agg(F.sum(F.octet_length(common.whole(text_col)).cast("long")).alias("bytes"))
    if targets is None:
        wanted = sizes.select("src", "bytes", F.pow(F.col("bytes").cast("double"), F.lit(SMOOTHING)).alias("w"))
    else:
        pairs = [F.when(F.col("src") == k, F.lit(float(v))) for k, v in sorted(targets.items())]
        wanted = sizes.select("src", "bytes", F.coalesce(*pairs, F.lit(0.0)).alias("w"))
    whole = wanted.agg(F.sum("bytes").cast("double").alias("total"), F.sum("w").alias("w_total"))
    # `whole` is one row, so this is no cross product
    return wanted.join(F.broadcast(whole)).select("src", "bytes", F.when((F.col("bytes") == 0) & (F.col("w") == 0), F.lit(1.0 if targets is None else 0.0)).when(F.col("bytes") == 0, 1.0).otherwise(F.round(F.col("w") / F.col("w_total") * F.col("total") / F.col("bytes"), 9)).alias("rate"))


def copies(u: Column, rate: Column) -> Column:
    """Smallest k whose Poisson distribution function exceeds u.  Rates beyond 20 are split into equal parts that
    are drawn on their own, so that the first term never vanishes."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("term"), F.exp(-rate).alias("cdf"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 12).cast("int")))
    walked = F.aggregate(
        steps, start,
        lambda s, i: F.struct(
            (s.k + (s.cdf <= u).cast("int")).alias("k"),
            (s.term * rate / i).alias("term"),
            (s.cdf + s.term * rate / i).alias("cdf"),
        ),
    )
    return walked.k


def mix(docs: DataFrame, targets: dict[str, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The replicated and globally shuffled rows: ``carry`` (default: all columns) with ``__copy`` and ``__place``."""
    common.bounded_batches(docs.sparkSession)
    clash = {"__src", "__key", "__rate", "__n", "__copy", "__place"} & set(docs.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    table = common.written(rates(docs, targets, source_col, text_col), "mix-rates")
    cols = carry if carry is not None else docs.columns
    base = docs.select(*cols, F.coalesce(source_col, F.lit("")).alias("__src"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(common.whole(text_col).cast("binary")))).alias("__key"))
    met = base.join(common.small(table.select(F.col("src").alias("__src"), F.col("rate").alias("__rate"))), "__src")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / 20).cast("int"))
    each = F.transform(F.sequence(F.lit(1), parts), lambda p: copies(unit(F.concat_ws(":", F.lit(str(seed)), F.col("__key"), p.cast("string"))), F.col("__rate") / parts))
    counted = met.withColumn("__n", F.aggregate(each, F.lit(0), lambda a, b: a + b)).where("__n > 0")
    out = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    out = out.withColumn("__place", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.col("__key"), F.col("__copy").cast("string")).cast("binary")))
    n = common.partitions(docs.sparkSession)
    # places are even, so their leading bits cut them into ranges without a first pass over the rows to sample them
    part = F.floor(F.conv(F.substring("__place", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * n).cast("int")
    return out.select(*cols, "__copy", "__rate", "__place").repartitionById(n, part).sortWithinPartitions("__place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, carry=["doc_id", "source"])
    return out.select("doc_id", "source", F.col("__copy").alias("copy"), F.col("__rate").alias("rate"), F.col("__place").alias("place"))


_TERMS = 80
ORACLE = f"""
WITH s AS (SELECT coalesce(source, '') AS src, sum(octet_length(encode(coalesce(text, '')))) AS bytes FROM documents GROUP BY 1),
w AS (SELECT src, bytes, pow(CAST(bytes AS DOUBLE), 0.5) AS w FROM s),
r AS (SELECT src, CASE WHEN bytes = 0 THEN 1.0::DOUBLE ELSE round(w / (SELECT sum(w) FROM w) * CAST((SELECT sum(bytes) FROM w) AS DOUBLE) / bytes, 9) END AS rate FROM w),
k AS (SELECT CAST(i AS INTEGER) AS i FROM range(0, {_TERMS}) t(i)),
terms AS (SELECT src, rate, i, exp(-rate) * pow(rate, i) / gamma(i + 1.0) AS term FROM r, k),
cdf AS (SELECT src, rate, i, sum(term) OVER (PARTITION BY src ORDER BY i) AS cdf FROM terms),
u AS (SELECT doc_id, source, coalesce(source, '') AS src,
      CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR) || ':1'), 1, 13)) AS BIGINT) / {float(_UNIT)!r} AS u FROM documents),
n AS (SELECT u.doc_id, u.source, cdf.rate, count(*) FILTER (WHERE cdf.cdf <= u.u) AS n FROM u JOIN cdf USING (src) GROUP BY ALL)
SELECT doc_id, source, CAST(c.copy AS INTEGER) AS copy, rate, md5('{SEED}s:' || CAST(doc_id AS VARCHAR) || ':' || CAST(c.copy AS VARCHAR)) AS place
FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy) c
"""
