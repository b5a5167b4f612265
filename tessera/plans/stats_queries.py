"""Queries of telemetry, paired experiments and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..operators import incremental, shared, stats
from ..streaming import events
from . import bindings as b


def tool_metrics(spark, sf):
    e = b.table(spark, sf, "events")
    return stats.tool_metrics(e.select(F.col("event_type").alias("tool"), F.col("value").alias("elapsed_ms"), F.get_json_object("props", "$.k").cast("long").alias("response_bytes"), (F.col("event_type") != "error").cast("int").alias("ok")))


TOOLS = """SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS response_bytes, round(sum(value), 3) AS elapsed_ms,
CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS successes FROM events GROUP BY event_type"""


def hook_counts(spark, sf):
    return stats.counts_by(b.hook_events(spark, sf), ["host", "activation", "reason"])


HOOK_COUNTS = f"WITH {b.HOOK} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM hook GROUP BY {d}" for d in ("host", "activation", "reason"))


def hook_report(spark, sf):
    return stats.hook_report(b.hook_events(spark, sf))


def _pct(by: str, value: str, q: float, src: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT {keys}round({value}, 3) AS v FROM (SELECT {keys}{value}, row_number() OVER ({part}ORDER BY {value}) - 1 AS i, count(*) OVER ({part}) AS n FROM {src} WHERE {value} IS NOT NULL) WHERE i = CAST(floor((n - 1) * {q}::DOUBLE) AS BIGINT)"


REPORT = f"""WITH {b.HOOK} SELECT count(*) AS events, round(avg(CASE WHEN activation = 'enabled' THEN 1.0::DOUBLE ELSE 0 END), 4) AS activation_rate, round(avg(elapsed_ms), 3) AS mean_ms,
CAST(sum(expected_engine_units) AS BIGINT) AS engine_units, CAST(sum(expected_native_units) AS BIGINT) AS native_units, min(timestamp) AS first_event_at, max(timestamp) AS last_event_at,
({_pct('', 'elapsed_ms', 0.5, 'hook')}) AS p50_ms, ({_pct('', 'elapsed_ms', 0.95, 'hook')}) AS p95_ms,
round(1 - sum(expected_engine_units) / nullif(CAST(sum(expected_native_units) AS DOUBLE), 0), 4) AS saving FROM hook"""


def latency_percentiles(spark, sf):
    return stats.floor_percentile(b.table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


LATENCY = f"SELECT a.event_type, a.v AS p50, z.v AS p95 FROM ({_pct('event_type', 'value', 0.5, 'events')}) a JOIN ({_pct('event_type', 'value', 0.95, 'events')}) z USING (event_type)"
def _exact(total: str, n: str) -> str:
    """The mean, half up to 4 places, of a sum in millionths, in whole numbers."""
    return f"CASE WHEN {n} > 0 THEN CAST((2 * CAST({total} AS HUGEINT) + 100 * {n}) // (200 * {n}) AS DOUBLE) / 10000.0::DOUBLE END"


_WINS = "count(*) FILTER (WHERE success)"
_micro = "sum(CAST(round(CAST({} AS DECIMAL(18,6)) * 1000000) AS HUGEINT))".format
_M = f"""count(*) AS runs, CAST({_WINS} AS BIGINT) AS successes, {_exact(f"{_WINS} * 1000000", "count(success)")} AS success_rate, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
{_exact(_micro('cost_usd'), _WINS)} AS cost_per_success, {_exact(_micro('tool_calls'), 'count(tool_calls)')} AS mean_calls, {_exact(_micro('latency_seconds'), 'count(latency_seconds)')} AS mean_latency"""


def paired_summary(spark, sf):
    return stats.summarize(b.runs(spark, sf))


def pair_check(spark, sf):
    r = b.runs(spark, sf)
    return stats.check_pairs(r.where("not (`group` = 'treatment' and task_id like '%3')").unionByName(r.where("task_id like '%4'")))


PAIRS = f"""WITH {b.RUNS}, x AS (SELECT * FROM runs WHERE NOT ("group" = 'treatment' AND task_id LIKE '%3') UNION ALL SELECT * FROM runs WHERE task_id LIKE '%4')
SELECT task_id, model, revision, run, count(*) FILTER (WHERE "group" = 'baseline') AS baselines, count(*) FILTER (WHERE "group" = 'treatment') AS treatments FROM x GROUP BY ALL HAVING baselines <> 1 OR treatments <> 1"""


def category_reduction(spark, sf):
    return stats.reduction(b.runs(spark, sf), ["repo"])


REDUCTION = f"""WITH {b.RUNS}, g AS (SELECT repo, CAST(coalesce(sum(input_tokens + output_tokens) FILTER (WHERE "group" = 'baseline'), 0) AS BIGINT) AS bt, CAST(coalesce(sum(input_tokens + output_tokens) FILTER (WHERE "group" = 'treatment'), 0) AS BIGINT) AS tt,
avg(CASE WHEN success THEN 1 ELSE 0 END) FILTER (WHERE "group" = 'baseline') AS bs, avg(CASE WHEN success THEN 1 ELSE 0 END) FILTER (WHERE "group" = 'treatment') AS ts FROM runs GROUP BY repo)
SELECT repo, bt AS baseline_tokens, tt AS treatment_tokens, round(1 - tt / nullif(CAST(bt AS DOUBLE), 0), 4) AS token_reduction, ts >= bs AS non_inferior FROM g"""


def dimension_sets(spark, sf):
    return stats.by_dimensions(b.runs(spark, sf), ["repo", "language", "scale"])


DIMENSIONS = f"WITH {b.RUNS} " + " UNION ALL ".join(f"""SELECT '{d}' AS dimension, {d} AS value, "group", {_M} FROM runs GROUP BY {d}, "group\"""" for d in ("repo", "language", "scale"))


def matrix_cube(spark, sf):
    r = b.runs(spark, sf)
    return stats.cell_means(r.select("language", F.col("scale").alias("size"), (F.col("input_tokens") % 100).cast("double").alias("reduction")))


CUBE = f"""WITH {b.RUNS} SELECT CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, CASE WHEN grouping(scale) = 1 THEN 'all' ELSE scale END AS size, round(avg(CAST(input_tokens % 100 AS DOUBLE)), 4) AS mean_reduction, count(*) AS n FROM runs GROUP BY CUBE (language, scale)"""


def wilson_interval(spark, sf):
    g = b.runs(spark, sf).groupBy("level").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("success").cast("int")).cast("double").alias("s"))
    low, high = stats.wilson(F.col("s"), F.col("n"))
    return g.select("level", low.alias("low"), high.alias("high"))


_Z = "1.959963984540054::DOUBLE"
WILSON = f"""WITH {b.RUNS}, g AS (SELECT level, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE success) AS DOUBLE) AS s FROM runs GROUP BY level), p AS (SELECT *, s / n AS p FROM g)
SELECT level, round(greatest(0.0::DOUBLE, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) AS low,
round(least(1.0::DOUBLE, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n)), 6) AS high FROM p"""


def bootstrap_ratio(spark, sf):
    r = b.runs(spark, sf)
    side = lambda g: F.max(F.when(F.col("group") == g, F.col("input_tokens")))
    pairs = r.groupBy("task_id", "level").agg(side("baseline").cast("double").alias("baseline"), side("treatment").cast("double").alias("treatment")).where("baseline > 0 and treatment > 0")
    return stats.bootstrap_log_ratio(pairs.select(F.col("level").cast("string").alias("stratum"), F.col("task_id").cast("long").alias("pair"), "baseline", "treatment"))


def median_latency(spark, sf):
    return b.runs(spark, sf).groupBy("group").agg(F.median("latency_seconds").alias("median_latency"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))


MEDIAN = f'WITH {b.RUNS} SELECT "group", median(latency_seconds) AS median_latency, round(avg(latency_seconds), 6) AS mean_latency FROM runs GROUP BY "group"'


def information_loss(spark, sf):
    d = b.table(spark, sf, "documents").select((F.col("doc_id") % 6).alias("level"), F.col("doc_id").alias("task_id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d{2,})"), F.lit(1))).alias("required"))
    return stats.information_loss(d.select("level", "task_id", F.lit("v").alias("name"), "required", F.when(F.length("required") % 3 == 0, None).otherwise(F.col("required")).alias("delivered")))


LOSS = r"""WITH f AS (SELECT doc_id % 6 AS level, unnest(regexp_extract_all(coalesce(text, ''), '\d{2,}')) AS required FROM documents)
SELECT CASE WHEN grouping(level) = 1 THEN 'all' ELSE CAST(level AS VARCHAR) END AS level, count(*) AS required, CAST(count(*) FILTER (WHERE length(required) % 3 = 0) AS BIGINT) AS lost FROM f GROUP BY ROLLUP (level)"""


def staged_totals(spark, sf):
    """Uncached and total tokens by group with success gates."""
    r = b.runs(spark, sf).withColumn("cached", F.expr("input_tokens div 3"))
    return r.groupBy("level", "group").agg(F.sum(F.col("input_tokens") - F.col("cached")).alias("uncached"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total"), F.every("success").alias("all_succeeded"), F.count_if("success").alias("successes"))


STAGED = f"""WITH {b.RUNS} SELECT level, "group", CAST(sum(input_tokens - input_tokens // 3) AS BIGINT) AS uncached, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total, bool_and(success) AS all_succeeded, count(*) FILTER (WHERE success) AS successes FROM runs GROUP BY level, "group\""""


def answer_families(spark, sf):
    """Ten closed forms over each order's ordered quantities, as folds over arrays."""
    rows = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q")))).alias("r"))
    x = rows.select("l_orderkey", F.transform("r", lambda e: e.q).alias("x"))
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, v: s + v)
    signed = F.transform("x", lambda v, i: F.when(i % 2 == 0, v).otherwise(-v))
    return x.select(
        "l_orderkey", total("x").alias("sum"), F.array_max("x").alias("max"), F.size(F.filter("x", lambda v: v % 2 == 0)).cast("long").alias("evens"), total(F.filter("x", lambda v: v % 2 == 1)).alias("odd_sum"),
        (F.array_max("x") - F.array_min("x")).alias("span"), F.aggregate("x", zero, lambda s, v: (s * 31 + v) % 997).alias("checksum"), total(F.transform("x", lambda v: v * v)).alias("squares"),
        F.size(F.filter("x", lambda v: v > 25)).cast("long").alias("above"), total(signed).alias("alternating"), F.aggregate("x", F.lit(1).cast("long"), lambda s, v: s * v % 997).alias("product"),
    )


FAMILIES = """WITH x AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS x FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(list_sum(x) AS BIGINT) AS sum, list_max(x) AS max, len(list_filter(x, lambda v: v % 2 = 0)) AS evens, CAST(coalesce(list_sum(list_filter(x, lambda v: v % 2 = 1)), 0) AS BIGINT) AS odd_sum, list_max(x) - list_min(x) AS span,
list_reduce(list_concat([CAST(0 AS BIGINT)], x), lambda s, v: (s * 31 + v) % 997) AS checksum, CAST(list_sum(list_transform(x, lambda v: v * v)) AS BIGINT) AS squares, len(list_filter(x, lambda v: v > 25)) AS above,
CAST(list_sum(list_transform(x, lambda v, i: CASE WHEN i % 2 = 1 THEN v ELSE -v END)) AS BIGINT) AS alternating, list_reduce(list_concat([CAST(1 AS BIGINT)], x), lambda s, v: s * v % 997) AS product FROM x"""


def agent_stream(spark, sf):
    """Event streams as JSON: the last completed turn and the number of commands of each user."""
    e = b.table(spark, sf, "events").select("user_id", F.to_json(F.struct("event_id", F.col("event_type").alias("type"), "value")).alias("line"))
    j = e.withColumn("j", F.from_json("line", "event_id long, type string, value double"))
    return j.groupBy("user_id").agg(F.max_by(F.when(F.col("j.type") == "purchase", F.col("j.value")), F.when(F.col("j.type") == "purchase", F.col("j.event_id"))).alias("last_turn"), F.count_if(F.col("j.type") == "click").alias("commands"))


STREAM = "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_turn, count(*) FILTER (WHERE event_type = 'click') AS commands FROM events GROUP BY user_id"


def answers_complete(spark, sf):
    """Whether each group of alternatives has one in the text."""
    groups = F.array(F.array(F.lit("the"), F.lit("der"), F.lit("la")), F.array(F.lit("."), F.lit("|")), F.array(F.lit("license"), F.lit("tion")))
    return b.table(spark, sf, "documents").select("doc_id", F.forall(groups, lambda g: F.exists(g, lambda w: F.lower(F.coalesce("text", F.lit(""))).contains(w))).alias("success"))


ANSWERS = "SELECT doc_id, list_bool_and(list_transform([['the', 'der', 'la'], ['.', '|'], ['license', 'tion']], lambda g: list_bool_or(list_transform(g, lambda w: contains(lower(coalesce(text, '')), w))))) AS success FROM documents"


def resumable_pairs(spark, sf):
    """Tasks whose pair of runs is not complete yet."""
    r = b.runs(spark, sf)
    done = r.where("success").groupBy("task_id").agg(F.count_distinct("group").alias("n")).where("n = 2")
    return r.select("task_id").distinct().join(done, "task_id", "left_anti")


RESUME = f'WITH {b.RUNS} SELECT DISTINCT task_id FROM runs WHERE task_id NOT IN (SELECT task_id FROM runs WHERE success GROUP BY task_id HAVING count(DISTINCT "group") = 2)'


def index_stats(spark, sf):
    s = b.symbols(spark, sf)
    return s.groupBy("language").agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.sum(F.when(~F.col("is_test"), F.col("end")).otherwise(0)).alias("production_lines"))


INDEX = f"""WITH {b.SYMBOLS} SELECT language, count(*) AS symbols, count(DISTINCT path) AS files, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths, CAST(sum(CASE WHEN NOT is_test THEN "end" ELSE 0 END) AS BIGINT) AS production_lines FROM symbols GROUP BY language"""


def snapshot_fingerprint(spark, sf):
    return stats.fingerprint(b.snapshots(spark, sf)[1], schemas.SCHEMA_VERSION)


FINGERPRINT = f"""WITH {b.SNAPSHOTS} SELECT sha256('{{"graph_schema":{schemas.SCHEMA_VERSION},"files":[' || string_agg('["' || path || '","' || hash || '"]', ',' ORDER BY path) || ']}}') AS fingerprint FROM new"""


def incremental_plan(spark, sf):
    return incremental.plan(*b.snapshots(spark, sf))


PLAN = f"""WITH {b.SNAPSHOTS} SELECT coalesce(old.path, new.path) AS path, CASE WHEN new.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'added' WHEN old.size = new.size AND old.mtime_ns = new.mtime_ns THEN 'reused'
WHEN old.hash = new.hash THEN 'refreshed' ELSE 'changed' END AS action FROM old FULL JOIN new ON old.path = new.path"""


def inventory_diff(spark, sf):
    return incremental.stale(*b.snapshots(spark, sf))


STALE = f"WITH {b.SNAPSHOTS} SELECT count(*) > 0 AS stale FROM old FULL JOIN new ON old.path = new.path WHERE old.size IS DISTINCT FROM new.size OR old.mtime_ns IS DISTINCT FROM new.mtime_ns"


def last_good(spark, sf):
    old, new = b.snapshots(spark, sf)
    k = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
    fresh = new.select("path", (k % 3 == 0).alias("failed"), F.when(k % 3 == 0, 0).otherwise(2).cast("long").alias("symbols"))
    return incremental.last_good(fresh, old.select("path", (k % 4).cast("long").alias("symbols")))


LAST = f"""WITH {b.SNAPSHOTS}, n AS (SELECT path, CAST(substr(path, 3) AS INT) AS k FROM new), j AS (SELECT n.path, k, CASE WHEN old.path IS NULL THEN 0 ELSE k % 4 END AS prior FROM n LEFT JOIN old ON n.path = old.path)
SELECT path, CAST(CASE WHEN k % 3 = 0 AND prior > 0 THEN prior WHEN k % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS symbols, k % 3 = 0 AND prior > 0 AS using_last_good, k % 3 = 0 AND prior > 0 AS analysis_stale FROM j"""


def posting_delta(spark, sf):
    from ..functions import text

    d = b.table(spark, sf, "documents")
    terms = lambda df: df.select("doc_id", F.explode(text.distinct_terms(F.coalesce("text", F.lit("")))).alias("term"))
    old = terms(d.where("doc_id % 13 <> 0")).withColumnRenamed("doc_id", "id")
    gone = d.where("doc_id % 7 = 0 or doc_id % 11 = 0").select(F.col("doc_id").alias("id"))
    fresh = terms(d.where("doc_id % 7 = 0 and doc_id % 11 <> 0").withColumn("text", F.concat("text", F.lit(" freshterm")))).withColumnRenamed("doc_id", "id")
    return incremental.apply_postings(old, gone, fresh).groupBy("term").agg(F.count("*").alias("df"))


DELTA = f"""WITH p AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 UNION ALL SELECT doc_id, coalesce(text || ' freshterm', '') FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0),
t AS (SELECT DISTINCT id, unnest({b.terms_sql('text')}) AS term FROM p) SELECT term, count(*) AS df FROM t GROUP BY term"""


def receipt_eviction(spark, sf):
    e = b.table(spark, sf, "events").select(F.concat(F.lit("receipt:"), F.col("event_id").cast("string")).alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created"))
    return incremental.evict(e, F.lit(1704067200.0 + 200000.0), keep=5000).select("key", "expired")


EVICT = """WITH r AS (SELECT 'receipt:' || event_id AS key, CAST(floor(epoch(ts)) AS DOUBLE) AS created FROM events), n AS (SELECT key FROM r ORDER BY created DESC, key DESC LIMIT 5000)
SELECT key, created < 1704067200.0 + 200000.0 - 86400 OR key NOT IN (SELECT key FROM n) AS expired FROM r"""


def live_receipts(spark, sf):
    """Events as receipts of their users, taken from the table by a stream that ends: those of each user's last week, the newest 100."""
    at, path = f"{shared.shared_dir(spark)}/receipts-{uuid.uuid4().hex}", f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern takes a file or a folder
    rows = e.select(F.col("user_id").cast("string").alias("workspace"), F.concat(F.lit("receipt:"), F.col("event_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("created"))
    sink = events.live_receipts(rows, 604_800).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out")
    sink.trigger(availableNow=True).start().awaitTermination()
    return events.current(spark.read.schema("workspace string, version long, key string, created timestamp").parquet(f"{at}/out")).select("workspace", "key")


LIVE = """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS workspace, 'receipt:' || event_id AS key, max(coalesce(epoch_us(ts), 0)) AS created FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, max(created) OVER (PARTITION BY workspace) AS newest, row_number() OVER (PARTITION BY workspace ORDER BY created DESC, key DESC) AS place FROM r)
SELECT workspace, key FROM n WHERE place <= 100 AND created >= newest - 604800000000"""


def last_wins(spark, sf):
    e = b.table(spark, sf, "events")
    return incremental.latest(e, ["user_id", "event_type"], F.col("event_id")).select("user_id", "event_type", "event_id", "value")


LAST_WINS = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def set_operations(spark, sf):
    old, new = b.snapshots(spark, sf)
    o, n = old.select("path"), new.select("path")
    tag = lambda df, x: df.withColumn("part", F.lit(x))
    return tag(o.exceptAll(n), "deleted").unionByName(tag(n.subtract(o), "added")).unionByName(tag(o.intersect(n), "both"))


SETS = f"WITH {b.SNAPSHOTS} SELECT path, 'deleted' AS part FROM (SELECT path FROM old EXCEPT SELECT path FROM new) UNION ALL SELECT path, 'added' FROM (SELECT path FROM new EXCEPT SELECT path FROM old) UNION ALL SELECT path, 'both' FROM (SELECT path FROM old INTERSECT SELECT path FROM new)"

QUERIES = {
    f.__name__: f
    for f in (
        tool_metrics, hook_counts, hook_report, latency_percentiles, paired_summary, pair_check, category_reduction, dimension_sets, matrix_cube, wilson_interval, bootstrap_ratio, median_latency, information_loss,
        staged_totals, answer_families, agent_stream, answers_complete, resumable_pairs, index_stats, snapshot_fingerprint, incremental_plan, inventory_diff, last_good, posting_delta, receipt_eviction, live_receipts, last_wins, set_operations,
    )
}
ORACLES = {
    "tool_metrics": TOOLS, "hook_counts": HOOK_COUNTS, "hook_report": REPORT, "latency_percentiles": LATENCY, "paired_summary": f'WITH {b.RUNS} SELECT "group", {_M} FROM runs GROUP BY "group"', "pair_check": PAIRS,
    "category_reduction": REDUCTION, "dimension_sets": DIMENSIONS, "matrix_cube": CUBE, "wilson_interval": WILSON, "median_latency": MEDIAN, "information_loss": LOSS, "staged_totals": STAGED, "answer_families": FAMILIES,
    "agent_stream": STREAM, "answers_complete": ANSWERS, "resumable_pairs": RESUME, "index_stats": INDEX, "snapshot_fingerprint": FINGERPRINT, "incremental_plan": PLAN, "inventory_diff": STALE, "last_good": LAST,
    "posting_delta": DELTA, "receipt_eviction": EVICT, "live_receipts": LIVE, "last_wins": LAST_WINS, "set_operations": SETS,
}
