"""Queries of budgeted selection: candidates, packing, sufficiency, routing, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lookup, pack
from . import bindings as b


def _targets(spark, sf):
    """Every order is the target of a task."""
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("id"))


def _nodes(spark, sf):
    """Orders and what they touch as symbols; suppliers are tests; customers of an order are its parents."""
    o = b.table(spark, sf, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("parent"), F.concat("o_orderpriority", F.lit(" "), F.col("o_totalprice").cast("string")).alias("source"))
    ends = [("c", "orders", "o_custkey"), ("p", "lineitem", "l_partkey"), ("s", "lineitem", "l_suppkey"), ("n", "supplier", "s_nationkey"), ("r", "nation", "n_regionkey")]
    others = [b.table(spark, sf, t).select(k).where(F.col(k).isNotNull()).distinct().select(F.concat(F.lit(p + "/"), F.col(k).cast("string")).alias("id")) for p, t, k in ends]
    rest = reduce(DataFrame.unionByName, others).select("id", F.lit(None).cast("string").alias("parent"), F.concat(F.lit("node "), F.regexp_replace("id", "/", " number ")).alias("source"))
    out = o.unionByName(rest)
    return out.select("*", F.substring_index("id", "/", 1).alias("path"), F.lit("node").alias("kind"), F.col("id").alias("qualname"), F.lit(None).cast("string").alias("signature"), F.sha2("source", 256).alias("hash"))


_NODES = """nodes AS (SELECT 'o/' || o_orderkey AS id, 'c/' || o_custkey AS parent FROM orders)"""


def _tests(spark, sf, targets):
    e = b.edges(spark, sf).where("kind = 'reference'")
    return targets.join(e, targets["id"] == e["source"]).select("task_id", F.col("target").alias("id"))


def candidates_context(spark, sf):
    targets, e = _targets(spark, sf), b.edges(spark, sf).where("kind <> 'reference'")
    out = pack.symbol_candidates(targets, _nodes(spark, sf), e, _tests(spark, sf, targets), "edit")
    return out.select("task_id", "id", "score", "role", "detail")


CONTEXT = f"""WITH {b.EDGES}, t AS (SELECT o_orderkey AS task_id, 'o/' || o_orderkey AS id FROM orders), e AS (SELECT * FROM edges WHERE kind <> 'reference'),
u AS (SELECT task_id, t.id, 1000.0::DOUBLE AS score, 'target' AS role, 'full' AS detail, 0 AS o FROM t JOIN orders ON t.id = 'o/' || o_orderkey
UNION ALL SELECT task_id, 'c/' || o_custkey, 900, 'parent', 'outline', 1 FROM t JOIN orders ON t.id = 'o/' || o_orderkey
UNION ALL SELECT task_id, target, 700 + least(sum(CASE WHEN kind = 'call' THEN 3 ELSE 1 END), 30), 'dependency', 'outline', 2 FROM t JOIN e ON t.id = source GROUP BY ALL
UNION ALL SELECT task_id, source, 600 + least(count(*), 30), 'caller', 'outline', 3 FROM t JOIN e ON t.id = target GROUP BY ALL
UNION ALL SELECT task_id, target, 800, 'test', 'outline', 4 FROM t JOIN edges ON t.id = source WHERE kind = 'reference')
SELECT task_id, id, score, role, detail FROM u QUALIFY row_number() OVER (PARTITION BY task_id, id ORDER BY score DESC, o) = 1"""


def _anchored(spark, sf, once=False):
    anchors = _targets(spark, sf).select(F.expr("task_id div 2").alias("task_id"), "id", (F.col("task_id") % 2).cast("int").alias("rank"), (F.col("task_id") * 7 % 150).cast("double").alias("score"), F.array(F.lit("order")).alias("evidence"))
    tests = _tests(spark, sf, anchors.select("task_id", "id")).join(anchors.where("rank = 0").select("task_id", "rank"), "task_id").distinct()
    return pack.task_candidates(anchors, _nodes(spark, sf), b.edges(spark, sf).where("kind <> 'reference'"), tests, "edit", once=once)


def candidates_dedupe(spark, sf):
    return _anchored(spark, sf).select("task_id", "id", "score", "role", "detail")


DEDUPE = f"""WITH {b.EDGES}, a AS (SELECT o_orderkey // 2 AS task_id, 'o/' || o_orderkey AS id, CAST(o_orderkey % 2 AS INT) AS rank, CAST(o_orderkey * 7 % 150 AS DOUBLE) AS score FROM orders), e AS (SELECT * FROM edges WHERE kind <> 'reference'),
k AS (SELECT a.*, 'c/' || o_custkey AS parent FROM a JOIN orders ON a.id = 'o/' || o_orderkey), u AS (
SELECT task_id, id, 1200 - rank * 80 + least(score, 100) AS score, 'task-anchor' AS role, CASE WHEN rank = 0 THEN 'full' ELSE 'outline' END AS detail, rank, 0 AS o FROM k
UNION ALL SELECT task_id, parent, 900 - rank * 20, 'parent', 'outline', rank, 1 FROM k
UNION ALL SELECT task_id, target, 720 - rank * 20 + CASE WHEN kind = 'call' THEN 12 ELSE 4 END, 'dependency', 'outline', rank, 2 FROM k JOIN e ON k.id = source
UNION ALL SELECT task_id, source, 640 - rank * 20, 'caller', 'outline', rank, 3 FROM (SELECT task_id, rank, source FROM k JOIN e ON k.id = target QUALIFY row_number() OVER (PARTITION BY task_id, target ORDER BY source) <= 4)
UNION ALL SELECT DISTINCT k.task_id, target, 820, 'test', 'full', 0, 4 FROM k JOIN edges ON k.id = source WHERE kind = 'reference')
SELECT task_id, id, CAST(score AS DOUBLE) AS score, role, detail FROM u QUALIFY row_number() OVER (PARTITION BY task_id, id ORDER BY score DESC, rank, o) = 1"""


def _blocks(spark, sf):
    out = pack.render(_anchored(spark, sf, once=True), _nodes(spark, sf), once=True)
    return out.withColumn("required", F.col("role") == "task-anchor").withColumn("known", F.col("id").endswith("7"))


def greedy_value_pack(spark, sf):
    return pack.greedy(_blocks(spark, sf), 1500)


def frontier_pack(spark, sf):
    d = _blocks(spark, sf).where("role <> 'task-anchor' and role <> 'parent'")
    d = d.select("task_id", "id", "role", "bytes", "terms").repartition("task_id")  # for places by role and for whole tasks
    rows = d.select("task_id", "id", "role", F.row_number().over(_by("task_id", "role", "id")).alias("ord"), "bytes", "terms", F.lit(200).alias("used"))
    return pack.frontier(rows, 800)


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols[:-1]).orderBy(cols[-1])


def _sized(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select((F.col("doc_id") % 50).alias("task_id"), F.col("doc_id").cast("string").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), (F.col("doc_id") % 7).alias("weight"))


_SIZED = "b AS (SELECT doc_id % 50 AS task_id, CAST(doc_id AS VARCHAR) AS id, octet_length(encode(coalesce(text, ''))) AS bytes, doc_id % 7 AS weight FROM documents)"


def first_fit_pack(spark, sf):
    return pack.first_fit(_sized(spark, sf), 20_000, ["weight"])


FIRST_FIT = f"""WITH RECURSIVE {_SIZED}, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight, id) AS n FROM b),
w AS (SELECT task_id, id, n, CASE WHEN bytes <= 20000 THEN bytes ELSE 0 END AS used, bytes <= 20000 AS included FROM o WHERE n = 1
UNION ALL SELECT o.task_id, o.id, o.n, CASE WHEN w.used + o.bytes <= 20000 THEN w.used + o.bytes ELSE w.used END, w.used + o.bytes <= 20000 FROM w JOIN o ON o.task_id = w.task_id AND o.n = w.n + 1)
SELECT task_id, id, included FROM w"""


def prefix_pack(spark, sf):
    return pack.prefix_fit(_sized(spark, sf), 20_000, [F.col("weight"), F.col("id")]).select("task_id", "id", F.col("running").cast("long").alias("running"), "included", "complete")


PREFIX = f"""WITH {_SIZED}, r AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY task_id ORDER BY weight, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM b)
SELECT task_id, id, running, running <= 20000 AS included, max(running) OVER (PARTITION BY task_id) <= 20000 AS complete FROM r"""


def evidence_sufficiency(spark, sf):
    s = _sized(spark, sf)
    req, rep = s.where("weight < 3").select("task_id", "id"), s.where("bytes < 8000").select("task_id", "id")
    return pack.sufficiency(req, rep, s.select("task_id").distinct()).select("task_id", F.array_join("missing", ",").alias("missing"), "evidence_state")


SUFFICIENT = f"""WITH {_SIZED}, m AS (SELECT task_id, string_agg(DISTINCT id, ',' ORDER BY id) AS missing FROM b WHERE weight < 3 AND bytes >= 8000 GROUP BY task_id)
SELECT t.task_id, coalesce(missing, '') AS missing, CASE WHEN missing IS NULL THEN 'sufficient' ELSE 'blocked-partial' END AS evidence_state FROM (SELECT DISTINCT task_id FROM b) t LEFT JOIN m USING (task_id)"""


def receipt_reuse(spark, sf):
    old, new = b.snapshots(spark, sf)
    return pack.split_receipt(new.select(F.col("path").alias("id"), "hash"), old.select(F.col("path").alias("id"), "hash")).select("id", "reused")


REUSE = f"WITH {b.SNAPSHOTS} SELECT new.path AS id, old.path IS NOT NULL AS reused FROM new LEFT JOIN old ON old.path = new.path AND old.hash = new.hash"


def _routes(spark, sf):
    p = b.prompts(spark, sf).withColumn("p", t.task_profile(F.col("text")))
    k = F.col("task_id")
    return p.select("task_id", F.col("p.estimated_native_reads").alias("native_reads"), t.intent(F.col("text")).alias("intent"), (k * 37 % 9000).alias("source_bytes"), (k % 6).cast("int").alias("n_paths"), (k % 900).alias("source_count"), (k * 13 % 5000).alias("evidence_bytes"), (k % 3 > 0).alias("sufficient"))


def cost_router(spark, sf):
    return pack.route(_routes(spark, sf)).select("task_id", "expected_native_units", "expected_engine_units", "expected_followup_units", "expected_saving", "activate")


def _route_sql() -> str:
    from .lookup_queries import INTENT, PROFILE

    return f"""pf AS (SELECT task_id, estimated_native_reads AS nr FROM ({PROFILE})), it AS (SELECT task_id, intent FROM ({INTENT})),
ro AS (SELECT pf.task_id AS task_id, it.intent AS intent, nr, pf.task_id * 37 % 9000 AS sb, pf.task_id % 6 AS np, pf.task_id % 900 AS sc, pf.task_id * 13 % 5000 AS eb, pf.task_id % 3 > 0 AS su FROM pf JOIN it ON pf.task_id = it.task_id),
rd AS (SELECT *, CASE WHEN intent = 'edit' THEN greatest(3, 1, nr, np) ELSE greatest(1, nr, np) END AS rr, CASE WHEN su THEN 0 ELSE greatest(600, eb // 2) END AS fo FROM ro),
rt AS (SELECT *, CAST(sb + rr * 320 + 160 + least(1200, sc * 2) AS BIGINT) AS nu, CAST(eb + 420 + fo AS BIGINT) AS eu FROM rd)"""


ROUTE = f"WITH {_route_sql()} SELECT task_id, nu AS expected_native_units, eu AS expected_engine_units, CAST(fo AS BIGINT) AS expected_followup_units, round(1 - eu / CAST(greatest(1, nu) AS DOUBLE), 4) AS expected_saving, su AND 1 - eu / CAST(greatest(1, nu) AS DOUBLE) >= 0.15 AS activate FROM rt"


def effective_route(spark, sf):
    r = pack.route(_routes(spark, sf)).withColumn("context_chars", F.col("evidence_bytes")).withColumn("requires_native", ~F.col("sufficient"))
    return pack.effective_route(r).select("task_id", "effective_units", "effective_followup", "effective_saving")


EFFECTIVE = f"""WITH {_route_sql()}, ef AS (SELECT task_id, nu, CASE WHEN su THEN 0 ELSE nu END AS f, eb + CASE WHEN su THEN 0 ELSE nu END AS e FROM rt)
SELECT task_id, CAST(e AS BIGINT) AS effective_units, CAST(f AS BIGINT) AS effective_followup, CASE WHEN nu <> 0 THEN round(1 - e / CAST(nu AS DOUBLE), 4) ELSE 0 END AS effective_saving FROM ef"""


def saving_footer(spark, sf):
    r = pack.route(_routes(spark, sf)).withColumn("payload_chars", F.col("evidence_bytes"))
    return pack.footer(r).select("task_id", "percent")


def decision_reason(spark, sf):
    r = pack.route(_routes(spark, sf))
    k = F.col("task_id")
    d = r.join(b.prompts(spark, sf), "task_id").select(
        "task_id", (k % 41 == 0).alias("failed"), (k % 37 != 0).alias("valid_repository"), t.is_code_task(F.col("text")).alias("is_code"), "source_count", (F.col("evidence_bytes") > 100).alias("has_evidence"),
        "sufficient", "activate", (k % 19 != 0).alias("complete"), (F.col("evidence_bytes") * 2).alias("payload_chars"),
    )
    return pack.decide(d).select("task_id", "reason", "activation", "evidence_state")


def _decision() -> str:
    from .lookup_queries import GATE

    return f"""WITH {_route_sql()}, gt AS ({GATE}), dr AS (SELECT rt.task_id AS task_id, CASE WHEN rt.task_id % 41 = 0 THEN 'internal_error' WHEN rt.task_id % 37 = 0 THEN 'invalid_repository' WHEN NOT is_code THEN 'non_code_task' WHEN sc = 0 THEN 'empty_repository'
WHEN eb <= 100 THEN 'no_evidence' WHEN NOT su THEN 'blocked_partial' WHEN 1 - eu / CAST(greatest(1, nu) AS DOUBLE) < 0.15 THEN 'low_expected_saving' WHEN rt.task_id % 19 = 0 THEN 'atomic_budget_exhausted' WHEN eb * 2 > 7800 THEN 'payload_limit' ELSE 'evidence_complete' END AS reason
FROM rt JOIN gt ON rt.task_id = gt.task_id)
SELECT task_id, reason, CASE reason WHEN 'evidence_complete' THEN 'enabled' WHEN 'internal_error' THEN 'failed' ELSE 'skipped' END AS activation,
CASE WHEN reason = 'evidence_complete' THEN 'sufficient' WHEN reason IN ('blocked_partial', 'atomic_budget_exhausted', 'payload_limit') THEN 'blocked-partial' ELSE 'unavailable' END AS evidence_state FROM dr"""


def response_shape(spark, sf):
    k = F.col("task_id")
    r = b.prompts(spark, sf).select("task_id", t.intent(F.col("text")).alias("intent"), (k % 3).alias("anchors"), (k % 2 + 1).alias("paths"), (k % 5 % 2).alias("omitted"), (k % 7 % 2).alias("reused"), (k * 11 % 3000).alias("file_bytes"), F.lit(2000).alias("budget"), (k * 11 % 3000 + 200).alias("file_response_bytes"), F.lit(1500).alias("compact_bytes"))
    return pack.shape(r).select("task_id", "delivery")


def _shape() -> str:
    from .lookup_queries import INTENT

    return f"""WITH it AS ({INTENT}) SELECT task_id, CASE WHEN task_id % 3 = 1 AND intent IN ('minimal', 'understand') AND task_id % 2 = 0 AND task_id % 5 % 2 = 0 AND task_id % 7 % 2 = 0 AND task_id * 11 % 3000 <= 2000 AND task_id * 11 % 3000 + 200 < 1500
THEN 'full-file-cost-bypass' ELSE 'symbol-pack' END AS delivery FROM it"""


def prepare_target(spark, sf):
    p = b.parts(spark, sf)
    q = p.where("p_partkey % 10 = 0").select(F.when(F.col("p_partkey") % 20 == 0, F.col("qualname")).otherwise(F.col("name")).alias("query")).distinct()
    return pack.resolve_query(lookup.find_all(q, p))


PREPARE = f"""WITH {b.PARTS}, q AS (SELECT DISTINCT CASE WHEN p_partkey % 20 = 0 THEN qualname ELSE name END AS query FROM parts WHERE p_partkey % 10 = 0), f AS (SELECT query, id, name FROM q JOIN parts ON contains(lower(id), lower(query))),
g AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE lower(name) = lower(query)) AS x, min(id) FILTER (WHERE lower(name) = lower(query)) AS e, min(id) AS a FROM f GROUP BY query)
SELECT query, CASE WHEN x = 1 THEN e WHEN n = 1 THEN a END AS id, x = 1 OR n = 1 AS ready FROM g"""

QUERIES = {
    f.__name__: f
    for f in (
        candidates_context, candidates_dedupe, greedy_value_pack, frontier_pack, first_fit_pack, prefix_pack, evidence_sufficiency, receipt_reuse, cost_router, effective_route, saving_footer,
        decision_reason, response_shape, prepare_target,
    )
}
ORACLES = {
    "candidates_context": CONTEXT, "candidates_dedupe": DEDUPE, "first_fit_pack": FIRST_FIT, "prefix_pack": PREFIX, "evidence_sufficiency": SUFFICIENT, "receipt_reuse": REUSE, "cost_router": ROUTE,
    "effective_route": EFFECTIVE, "decision_reason": _decision(), "response_shape": _shape(), "prepare_target": PREPARE,
}
