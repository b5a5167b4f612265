"""Queries of rendering: excerpts, blocks, hints, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from . import bindings as b


def frontier_excerpts(spark, sf):
    d = b.table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.sha2(t.frontier_excerpt(F.col("text"), "license", F.lit(1)), 256).alias("digest"))


EXCERPTS = r"""WITH d AS (SELECT doc_id, rtrim(text, ' ') AS s, string_split(rtrim(text, ' '), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, greatest(coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)(^|[^A-Za-z0-9_])license([^A-Za-z0-9_]|$)')), true), 1) - 1, 0) AS hit FROM d),
e AS (SELECT *, greatest(0, hit - 8) AS a, least(len(l), hit + 13) AS z FROM h)
SELECT doc_id, sha256(CASE WHEN octet_length(encode(s)) <= 1200 THEN s ELSE '# excerpt lines ' || (1 + a) || '-' || z || chr(10) || array_to_string(l[a + 1:z], chr(10)) END) AS digest FROM e"""


def context_blocks(spark, sf):
    p = b.table(spark, sf, "part")
    pack = F.concat(F.lit("intro "), "p_name", F.lit("\n# task-anchor: "), "p_brand", F.lit("\nbody\n\n# caller: "), "p_type", F.lit("\nmore # not one\n"))
    return p.select("p_partkey", F.posexplode(t.context_blocks(pack)).alias("n", "block"))


BLOCKS = """SELECT p_partkey, CAST(n AS INTEGER) AS n, block FROM (SELECT p_partkey, 0 AS n, 'intro ' || p_name AS block FROM part UNION ALL SELECT p_partkey, 1, chr(10) || '# task-anchor: ' || p_brand || chr(10) || 'body' || chr(10) FROM part
UNION ALL SELECT p_partkey, 2, chr(10) || '# caller: ' || p_type || chr(10) || 'more # not one' || chr(10) FROM part)"""


def validation_hints(spark, sf):
    p, k = b.table(spark, sf, "part"), F.col("p_partkey")
    path = F.concat("p_name", F.element_at(F.array(*(F.lit(x) for x in (".py", ".ts", ".rs", ".c", ".md"))), (k % 5 + 1).cast("int")))
    callees = F.when(k % 3 == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", t.validation_hint(F.array(path), k % 2 == 0, k % 4 == 0, F.col("p_type"), callees).alias("hint"))


HINTS = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Run Python with ./src on its path.' ELSE 'Run Python from the root.' END WHEN 1 THEN 'Run one Node or package-script check from the root.'
WHEN 2 THEN CASE WHEN p_partkey % 4 = 0 THEN 'Run one cargo test from the root.' END WHEN 3 THEN 'Compile only ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN '; replace ' || p_type || ', ' || p_brand || ' by stubs' ELSE '' END || ', and run its boundary cases.' END AS hint FROM part"""


def suppression_hints(spark, sf):
    p, k = b.table(spark, sf, "part"), F.col("p_partkey")
    lines = F.array_join(F.array_repeat(F.lit("x"), (k % 4).cast("int")), "\n")
    body = F.when(k % 4 == 0, "open(p, errors='ignore')").when(k % 4 == 1, "value.ok()").when(k % 4 == 2, "try { } catch (e) { }").otherwise("fine")
    return p.select("p_partkey", F.inline(t.suppressions(F.concat(lines, F.lit("\n"), body))))


SUPPRESSED = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ignored decoding errors' WHEN 1 THEN 'discarded result' ELSE 'empty catch' END AS what, CAST(CASE p_partkey % 4 WHEN 2 THEN 3 ELSE 2 END AS INTEGER) AS line FROM part WHERE p_partkey % 4 < 3"""


def diagnostic_texts(spark, sf):
    p, k = b.table(spark, sf, "part"), F.col("p_partkey")
    missing = F.when(k % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", t.diagnostic_text(F.lit("blocked_partial"), missing, k % 5).alias("text"))


DIAGNOSTIC = "SELECT p_partkey, 'reason: blocked_partial' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'missing: ' || p_name || ', ' || p_type || chr(10) ELSE '' END || 'omitted blocks: ' || (p_partkey % 5) || chr(10) AS text FROM part"

QUERIES = {f.__name__: f for f in (frontier_excerpts, context_blocks, validation_hints, suppression_hints, diagnostic_texts)}
ORACLES = {"frontier_excerpts": EXCERPTS, "context_blocks": BLOCKS, "validation_hints": HINTS, "suppression_hints": SUPPRESSED, "diagnostic_texts": DIAGNOSTIC}
