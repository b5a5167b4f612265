"""Canonical tables bound to the synthetic ones, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as symbols; those labelled toxic stand for tests."""
    d = table(spark, sf, "documents")
    flags = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    word = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z0-9]+)", 1))
    name = F.when(word == "", "none").otherwise(word)
    return d.join(flags, "doc_id", "left").select(
        F.concat_ws("::", path, F.col("doc_id").cast("string")).alias("id"), path.alias("path"), name.alias("name"), name.alias("qualname"), F.col("lang").alias("kind"),
        F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"), F.col("lang").alias("language"), F.lit("table").alias("backend"), F.lit(False).alias("editable"),
        F.lit(False).alias("analysis_stale"), F.col("text").alias("source"), F.sha2("text", 256).alias("hash"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("signature"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_test"), "doc_id",
    )


SYMBOLS = r"""
lb AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
symbols AS (SELECT coalesce(d.source, '') || '/' || coalesce(d.lang, '') || '::' || d.doc_id AS id, coalesce(d.source, '') || '/' || coalesce(d.lang, '') AS path,
  CASE WHEN regexp_extract(coalesce(text, ''), '[A-Za-z0-9]+') = '' THEN 'none' ELSE lower(regexp_extract(text, '[A-Za-z0-9]+')) END AS name,
  CASE WHEN regexp_extract(coalesce(text, ''), '[A-Za-z0-9]+') = '' THEN 'none' ELSE lower(regexp_extract(text, '[A-Za-z0-9]+')) END AS qualname,
  d.lang AS kind, d.lang AS language, text AS source, sha256(text) AS hash, CAST(len(string_split(text, chr(10))) AS INTEGER) AS "end",
  coalesce(lb.toxic, 0) = 1 AS is_test, d.doc_id FROM documents d LEFT JOIN lb ON d.doc_id = lb.doc_id)
"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols, with many equal names."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat("p_brand", F.lit("::"), F.regexp_replace("p_name", " ", "_"), F.lit("."), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("path"), F.regexp_replace("p_name", " ", "_").alias("name"),
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("."), F.col("p_partkey").cast("string")).alias("qualname"), F.col("p_type").alias("kind"), (F.col("p_size") > 45).alias("is_test"), "p_partkey",
    )


PARTS = """
parts AS (SELECT p_brand || '::' || replace(p_name, ' ', '_') || '.' || p_partkey AS id, p_brand AS path, replace(p_name, ' ', '_') AS name,
  replace(p_name, ' ', '_') || '.' || p_partkey AS qualname, p_type AS kind, p_size > 45 AS is_test, p_partkey FROM part)
"""


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), "text")


TASKS = "tasks AS (SELECT item_id AS task_id, text FROM benchmark)"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Task prompts made of part names, with verbs, identifiers and questions by turns."""
    p = table(spark, sf, "part")
    name, dotted = F.regexp_replace("p_name", " ", "_"), F.concat(F.lower("p_type"), F.lit("."), F.regexp_replace("p_name", " ", "_"))
    k = F.col("p_partkey") % 8
    text = (
        F.when(k == 0, F.concat(F.lit("Please modify the "), name, F.lit(" and update "), dotted)).when(k == 1, F.concat(F.lit("what does "), dotted, F.lit(" return"), F.lit("?")))
        .when(k == 2, F.concat(F.lit("which callers are affected by "), name)).when(k == 3, F.concat(F.lit("compare "), name, F.lit(" and "), F.col("p_name")))
        .when(k == 4, F.concat(F.lit("run the tests of "), F.col("p_name"))).when(k == 5, F.concat(F.lit("calculate the result of "), name))
        .when(k == 6, F.concat(F.lit("hello "), F.col("p_name"))).otherwise(F.concat(F.lit("see src/"), name, F.lit(".py for more")))
    )
    return p.select(F.col("p_partkey").alias("task_id"), text.alias("text"))


PROMPTS = """
prompts AS (SELECT p_partkey AS task_id, CASE p_partkey % 8
  WHEN 0 THEN 'Please modify the ' || replace(p_name, ' ', '_') || ' and update ' || lower(p_type) || '.' || replace(p_name, ' ', '_')
  WHEN 1 THEN 'what does ' || lower(p_type) || '.' || replace(p_name, ' ', '_') || ' return?'
  WHEN 2 THEN 'which callers are affected by ' || replace(p_name, ' ', '_')
  WHEN 3 THEN 'compare ' || replace(p_name, ' ', '_') || ' and ' || p_name
  WHEN 4 THEN 'run the tests of ' || p_name
  WHEN 5 THEN 'calculate the result of ' || replace(p_name, ' ', '_')
  WHEN 6 THEN 'hello ' || p_name
  ELSE 'see src/' || replace(p_name, ' ', '_') || '.py for more' END AS text FROM part)
"""


def edges(spark: SparkSession, sf: str, once: bool = True) -> DataFrame:
    """Customer calls order, order calls part and refers to supplier, supplier depends on nation, nation on region.  Without
    ``once`` an edge may be there several times, and nothing is exchanged."""
    t = lambda n: table(spark, sf, n)

    def arc(df: DataFrame, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        pairs = df.select(ka, kb)
        pairs = pairs.distinct() if once else pairs  # numbers are exchanged, not their texts
        return pairs.select(F.concat(F.lit(a + "/"), F.col(ka).cast("string")).alias("source"), F.concat(F.lit(b + "/"), F.col(kb).cast("string")).alias("target"), F.lit(kind).alias("kind"))

    out = arc(t("orders"), "c", "o_custkey", "o", "o_orderkey", "call")
    out = out.unionByName(arc(t("lineitem"), "o", "l_orderkey", "p", "l_partkey", "call")).unionByName(arc(t("lineitem"), "o", "l_orderkey", "s", "l_suppkey", "reference"))
    out = out.unionByName(arc(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "dependency")).unionByName(arc(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "dependency"))
    return out.select("source", F.substring_index("source", "/", 1).alias("path"), F.lit(1).alias("line"), F.col("target").alias("name"), "kind", "target", F.lit("static_candidate").alias("confidence"))


EDGES = """
edges AS (SELECT source, split_part(source, '/', 1) AS path, 1 AS line, target AS name, kind, target, 'static_candidate' AS confidence FROM (
  SELECT DISTINCT 'c/' || o_custkey AS source, 'o/' || o_orderkey AS target, 'call' AS kind FROM orders
  UNION SELECT DISTINCT 'o/' || l_orderkey, 'p/' || l_partkey, 'call' FROM lineitem
  UNION SELECT DISTINCT 'o/' || l_orderkey, 's/' || l_suppkey, 'reference' FROM lineitem
  UNION SELECT DISTINCT 's/' || s_suppkey, 'n/' || s_nationkey, 'dependency' FROM supplier
  UNION SELECT DISTINCT 'n/' || n_nationkey, 'r/' || n_regionkey, 'dependency' FROM nation))
"""


def ids(spark: SparkSession, prefix: str, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit(prefix + "/"), F.col("id").cast("string")).alias("id"))


def hook_events(spark: SparkSession, sf: str) -> DataFrame:
    e, t = table(spark, sf, "events"), F.col("event_type")
    native = F.when(t == "view", 0).otherwise((F.col("value") * 10).cast("long"))
    return e.select(
        F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("host"), F.when(t == "purchase", "enabled").when(t == "error", "failed").otherwise("skipped").alias("activation"), t.alias("reason"),
        F.col("value").alias("elapsed_ms"), F.get_json_object("props", "$.k").cast("long").alias("expected_engine_units"), native.alias("expected_native_units"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )


HOOK = """
hook AS (SELECT 'host' || (user_id % 4) AS host, CASE event_type WHEN 'purchase' THEN 'enabled' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS activation, event_type AS reason,
  value AS elapsed_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS expected_engine_units,
  CASE WHEN event_type = 'view' THEN 0 ELSE CAST(trunc(value * 10) AS BIGINT) END AS expected_native_units, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events)
"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by supplier and status as paired runs: status F is the baseline, O the treatment."""
    li = table(spark, sf, "lineitem").where(F.col("l_linestatus").isin("F", "O"))
    g = li.groupBy(F.col("l_suppkey").alias("k"), "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity")).cast("long").alias("q"), F.max("l_linenumber").alias("m"))
    key = F.col("k").cast("string")
    return g.select(
        key.alias("task_id"), F.when(F.col("l_linestatus") == "F", "baseline").otherwise("treatment").alias("group"), F.lit("m").alias("model"), F.lit("r1").alias("revision"), F.lit(1).alias("run"),
        (F.col("q") % 3 > 0).alias("success"), F.col("q").alias("input_tokens"), F.col("n").alias("output_tokens"), (F.col("q") / 1000.0).alias("cost_usd"), F.col("m").cast("long").alias("tool_calls"),
        (F.col("n") / 10.0).alias("latency_seconds"), F.concat(F.lit("repo"), (F.col("k") % 5).cast("string")).alias("repo"), F.concat(F.lit("lang"), (F.col("k") % 3).cast("string")).alias("language"), F.concat(F.lit("size"), (F.col("k") % 4).cast("string")).alias("scale"), (F.col("k") % 6).alias("level"),
    )


RUNS = """
runs AS (SELECT CAST(k AS VARCHAR) AS task_id, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'treatment' END AS "group", 'm' AS model, 'r1' AS revision, 1 AS run,
  q % 3 > 0 AS success, q AS input_tokens, n AS output_tokens, q / 1000.0::DOUBLE AS cost_usd, CAST(m AS BIGINT) AS tool_calls, n / 10.0::DOUBLE AS latency_seconds,
  'repo' || (k % 5) AS repo, 'lang' || (k % 3) AS language, 'size' || (k % 4) AS scale, k % 6 AS level
  FROM (SELECT l_suppkey AS k, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_linenumber) AS m FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY ALL))
"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents as files: the second lacks every 11th, changes every 7th and touches every 5th."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    old = d.where("doc_id % 13 <> 0").select("path", F.sha2("t", 256).alias("hash"), F.octet_length("t").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t"))
    new = d.where("doc_id % 11 <> 0").select("path", F.sha2(text, 256).alias("hash"), F.octet_length(text).cast("long").alias("size"), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).cast("long").alias("mtime_ns"))
    return old, new


SNAPSHOTS = """
d AS (SELECT doc_id, 'd/' || doc_id AS path, coalesce(text, '') AS t, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS u FROM documents),
old AS (SELECT path, sha256(t) AS hash, octet_length(encode(t)) AS size, 1 AS mtime_ns FROM d WHERE doc_id % 13 <> 0),
new AS (SELECT path, sha256(u) AS hash, octet_length(encode(u)) AS size, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS mtime_ns FROM d WHERE doc_id % 11 <> 0)
"""

TERMS = """flatten(list_transform(regexp_extract_all(replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[A-Za-z0-9]+|[㐀-鿿]+'),
  lambda c: CASE WHEN regexp_matches(c, '^[㐀-鿿]') THEN list_concat([c], list_transform(range(1, length(c)), lambda i: substr(c, CAST(i AS BIGINT), 2)))
  WHEN length(c) > 1 THEN [lower(c)] ELSE CAST([] AS VARCHAR[]) END))"""


def terms_sql(x: str) -> str:
    return TERMS.format(x)


def distinct_sql(x: str) -> str:
    """Distinct list in first-seen order."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
