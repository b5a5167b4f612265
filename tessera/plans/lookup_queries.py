"""Queries of lookup, text functions and task analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lookup
from . import bindings as b


def find_substring(spark, sf):
    out = lookup.find(b.parts(spark, sf), "small_ring", limit=200)
    return out.select("id", "name", "total", "truncated")


FIND = f"""WITH {b.PARTS}, h AS (SELECT * FROM parts WHERE contains(lower(id), 'small_ring'))
SELECT id, name, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 200 AS truncated FROM h ORDER BY lower(name) <> 'small_ring', id LIMIT 200"""


def find_kind_page(spark, sf):
    return lookup.find(b.parts(spark, sf), "brand#1", kind="ECONOMY", limit=30).select("id", "kind", "total", "truncated")


FIND_KIND = f"""WITH {b.PARTS}, h AS (SELECT * FROM parts WHERE contains(lower(id), 'brand#1') AND kind = 'ECONOMY')
SELECT id, kind, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 30 AS truncated FROM h ORDER BY lower(name) <> 'brand#1', id LIMIT 30"""


def symbol_summary(spark, sf):
    return lookup.summary(lookup.compact(b.symbols(spark, sf))).select("id", "name", "qualname", "kind", "path", "end", "language")


SUMMARY = f'WITH {b.SYMBOLS} SELECT id, name, qualname, kind, path, "end", language FROM symbols'


def point_get_fresh(spark, sf):
    old, new = b.snapshots(spark, sf)
    symbols = old.select(F.col("path").alias("id"), "path", F.col("hash").alias("file_hash"))
    wanted = b.ids(spark, "d", 200)
    return lookup.get_fresh(symbols, new, wanted).select("id", "fresh")


FRESH = f"""WITH {b.SNAPSHOTS}, w AS (SELECT 'd/' || i AS id FROM range(200) r(i))
SELECT old.path AS id, coalesce(new.hash = old.hash, false) AS fresh FROM old LEFT JOIN new ON old.path = new.path WHERE old.path IN (SELECT id FROM w)"""


def nocase_lookup(spark, sf):
    return lookup.exact_symbols(b.prompts(spark, sf), b.parts(spark, sf))


_IDENT = r"""ident AS (SELECT task_id, text, unnest(regexp_extract_all(text, '[_A-Za-z][_A-Za-z0-9]*(?:\.[_A-Za-z][_A-Za-z0-9]*)*')) AS v FROM prompts),
code AS (SELECT DISTINCT task_id, v, string_split(v, '.')[-1] AS leaf FROM ident WHERE (contains(v, '_') OR contains(v, '.')
  OR (string_split(v, '.')[-1] = upper(string_split(v, '.')[-1]) AND regexp_matches(string_split(v, '.')[-1], '[A-Z]')) OR regexp_matches(substr(string_split(v, '.')[-1], 2), '[A-Z]'))
  AND lower(v) NOT IN ('what','which','where','when','return','default','current','source','code','with','from','into','true','false'))"""
NOCASE = f"""WITH {b.PARTS}, {b.PROMPTS}, {_IDENT}
SELECT DISTINCT task_id, id FROM code JOIN parts ON lower(leaf) = lower(name) WHERE (NOT contains(v, '.') OR lower(v) IN (lower(name), lower(qualname)))"""


def symbol_exists(spark, sf):
    names = b.prompts(spark, sf).select("task_id", F.explode(t.task_identifiers(F.col("text"))).alias("name"))
    return lookup.existing(names, b.parts(spark, sf)).distinct()


EXISTS = f"WITH {b.PARTS}, {b.PROMPTS}, {_IDENT} SELECT DISTINCT task_id, v AS name FROM code WHERE lower(leaf) IN (SELECT lower(name) FROM parts)"


def edge_predicates(spark, sf):
    e = b.edges(spark, sf)
    return lookup.edge_filter(e, "in", b.ids(spark, "p", 50), kind="call", unresolved=False).select("source", "target", "kind")


EDGE_PREDICATES = f"WITH {b.EDGES} SELECT source, target, kind FROM edges WHERE kind = 'call' AND target IN (SELECT 'p/' || i FROM range(50) r(i))"


def path_guard(spark, sf):
    u = b.table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^\w+://", "").alias("p"))
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../"), "p")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("/"), "p")).when(F.col("page_id") % 5 == 2, F.concat(F.lit(".index/"), "p")).otherwise(F.col("p"))
    return u.select("page_id", lookup.safe_path(path).alias("safe"))


GUARD = "SELECT page_id, page_id % 5 > 2 AS safe FROM pages"


def search_terms(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws(" ", t.search_terms(F.coalesce("text", F.lit("")))).alias("terms"))


TERMS = f"SELECT doc_id, array_to_string({b.terms_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, ' ') AS terms FROM documents"


def task_identifiers(spark, sf):
    return b.prompts(spark, sf).select("task_id", F.explode(t.task_identifiers(F.col("text"))).alias("identifier"))


IDENTIFIERS = f"WITH {b.PROMPTS}, {_IDENT} SELECT task_id, v AS identifier FROM code"


def creation_targets(spark, sf):
    p = b.prompts(spark, sf).withColumn("text", F.concat(F.lit("please create function "), F.regexp_extract("text", r"([A-Za-z]+_[A-Za-z]+)", 1), F.lit("_v2() here")))
    return p.select("task_id", F.explode(t.creation_targets(F.col("text"))).alias("target"))


CREATION = f"WITH {b.PROMPTS} SELECT task_id, regexp_extract(text, '[A-Za-z]+_[A-Za-z]+') || '_v2' AS target FROM prompts"


def edit_targets(spark, sf):
    return b.prompts(spark, sf).select("task_id", F.explode(t.edit_targets(F.col("text"))).alias("target"))


EDIT = rf"""WITH {b.PROMPTS} SELECT DISTINCT task_id, target FROM (SELECT task_id,
unnest(regexp_extract_all(text, '(?is)(?:modify|change|fix|refactor|update|extend)\s+(?:the\s+)?([_A-Za-z][_A-Za-z0-9]*(?:\.[_A-Za-z][_A-Za-z0-9]*)*)', 1)) AS target FROM prompts)"""


def identifier_key(spark, sf):
    return b.prompts(spark, sf).select("task_id", t.identifier_key(F.col("text")).alias("key"))


KEY = r"""WITH """ + b.PROMPTS + r""" SELECT task_id, regexp_replace(lower(regexp_replace(text, '(?i)\.(?:py|pyi|js|jsx|ts|tsx|go|rs|java|c|cc|cpp|h|hpp|cs|rb|php)(::|$)', '\1', 'g')), '[^a-z0-9_]+', '', 'g') AS key FROM prompts"""


def external_identifiers(spark, sf):
    n = b.table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("json.dumps"), F.lit("x.print"), F.lit("my.helper"), F.lit("API"), F.lit("len")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    return n.select("p_partkey", "name", t.is_external(F.col("name")).alias("external"))


EXTERNAL = "SELECT p_partkey, ['json.dumps', 'x.print', 'my.helper', 'API', 'len'][p_partkey % 5 + 1] AS name, p_partkey % 5 IN (1, 3, 4) AS external FROM part"


def _any(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def task_profile(spark, sf):
    return b.prompts(spark, sf).select("task_id", t.task_profile(F.col("text")).alias("p")).select("task_id", "p.breadth", "p.behavior_task", "p.relation_task", "p.estimated_native_reads", "p.recommended")


PROFILE = f"""WITH {b.PROMPTS}, {_IDENT}, n AS (SELECT p.task_id, p.text, count(c.v) AS n, coalesce(bool_or(contains(c.v, '.') AND NOT regexp_matches(lower(c.v), '\\.(py|js|ts|tsx|go|rs|java|c|cc|cpp|cs|rb|php)$')), false) AS q
 FROM prompts p LEFT JOIN code c ON p.task_id = c.task_id GROUP BY p.task_id, p.text),
f AS (SELECT *, {_any(t.RELATION_WORDS)} AS rel, {_any(t.BEHAVIOR_WORDS)} AS beh, n >= 2 OR {_any(t.MULTI_WORDS)} AS multi FROM n)
SELECT task_id, CASE WHEN rel THEN 'broad' WHEN q OR n = 1 THEN 'narrow' WHEN multi THEN 'balanced' ELSE 'narrow' END AS breadth, beh AS behavior_task, rel AS relation_task,
 CASE WHEN rel THEN 4 WHEN multi THEN 3 WHEN n > 0 THEN 1 ELSE 2 END AS estimated_native_reads, CASE WHEN rel THEN 4 WHEN multi THEN 3 WHEN n > 0 THEN 1 ELSE 2 END >= 3 AS recommended FROM f"""


def task_intent(spark, sf):
    return b.prompts(spark, sf).select("task_id", t.intent(F.col("text")).alias("intent"), t.budget(t.task_profile(F.col("text")).breadth).alias("budget"))


INTENT = f"""WITH i AS (SELECT task_id, text FROM (WITH {b.PROMPTS} SELECT * FROM prompts)), p AS ({PROFILE})
SELECT i.task_id, CASE WHEN {_any(t.EDIT_WORDS)} THEN 'edit' WHEN {_any(t.IMPACT_WORDS)} THEN 'impact' WHEN {_any(t.TEST_WORDS)} THEN 'test' ELSE 'understand' END AS intent,
 CASE breadth WHEN 'broad' THEN 6000 WHEN 'balanced' THEN 4000 ELSE 2200 END AS budget FROM i JOIN p ON i.task_id = p.task_id"""


def code_task_gate(spark, sf):
    return b.prompts(spark, sf).select("task_id", t.is_code_task(F.col("text")).alias("is_code"))


GATE = f"""WITH {b.PROMPTS}, {_IDENT} SELECT task_id, {_any(t.CODE_SIGNALS)} OR task_id IN (SELECT task_id FROM code) AS is_code FROM prompts"""


def test_path_flags(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*(F.lit(x) for x in _PATHS)), (F.col("p_partkey") % len(_PATHS) + 1).cast("int")).alias("path"))
    return p.select("p_partkey", t.is_test_path(F.col("path")).alias("is_test"), t.language_of(F.col("path")).alias("language"), t.module_name(F.col("path")).alias("module"))


_PATHS = ["src/app.py", "tests/app.py", "src/test_app.py", "a/app_spec.ts", "pkg/__init__.py", "b/contest.go", "c/Spec.rb", "d/app.test.js", "x/test/readme.rs"]
_WANT = [(False, "python", "src.app"), (True, "python", "tests.app"), (True, "python", "src.test_app"), (True, "typescript", "a.app_spec"), (False, "python", "pkg"), (False, "go", "b.contest"), (True, "ruby", "c.Spec"), (True, "javascript", "d.app.test"), (True, "rust", "x.test.readme")]
PATHS = "SELECT p_partkey, w.t AS is_test, w.l AS language, w.m AS module FROM part JOIN (VALUES " + ", ".join(f"({i}, {str(a).lower()}, '{l}', '{m}')" for i, (a, l, m) in enumerate(_WANT)) + f") w(i, t, l, m) ON p_partkey % {len(_PATHS)} = w.i"


def file_records(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(t.normalize_newlines(F.coalesce("text", F.lit(""))), 256).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


RECORDS = r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS hash, octet_length(encode(coalesce(text, ''))) AS size FROM documents"


def focused_lines(spark, sf):
    d = b.table(spark, sf, "documents").where("text is not null")
    terms, names = F.array(F.lit("the"), F.lit("que"), F.lit("der")), F.array(F.lit("license"))
    return d.select("doc_id", F.concat_ws(",", F.transform(t.excerpt_lines(F.col("text"), terms, names), lambda i: i.cast("string"))).alias("lines"))


FOCUSED = """WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS i, s[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(0, len(s))) AS i)),
sc AS (SELECT doc_id, i, line, contains(replace(lower(line), '_', ' '), 'the')::INT + contains(replace(lower(line), '_', ' '), 'que')::INT + contains(replace(lower(line), '_', ' '), 'der')::INT + 20 * contains(lower(line), 'license')::INT AS score FROM l),
c AS (SELECT doc_id, min(i) AS c FROM l WHERE contains(lower(line), 'license') GROUP BY doc_id
 UNION SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM sc WHERE score > 0) WHERE r <= 4),
k AS (SELECT DISTINCT l.doc_id, l.i, l.line FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND abs(l.i - c.c) <= 4 WHERE l.i = 0 OR c.c IS NOT NULL),
u AS (SELECT doc_id, i, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS used FROM k)
SELECT d.doc_id, coalesce(string_agg(CAST(u.i AS VARCHAR), ',' ORDER BY u.i) FILTER (WHERE u.used <= 1400), '') AS lines FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY d.doc_id"""

QUERIES = {
    "find_substring": find_substring, "find_kind_page": find_kind_page, "symbol_summary": symbol_summary, "point_get_fresh": point_get_fresh, "nocase_lookup": nocase_lookup,
    "symbol_exists": symbol_exists, "edge_predicates": edge_predicates, "path_guard": path_guard, "search_terms": search_terms, "task_identifiers": task_identifiers,
    "creation_targets": creation_targets, "edit_targets": edit_targets, "identifier_key": identifier_key, "external_identifiers": external_identifiers, "task_profile": task_profile,
    "task_intent": task_intent, "code_task_gate": code_task_gate, "test_path_flags": test_path_flags, "file_records": file_records, "focused_lines": focused_lines,
}
ORACLES = {
    "find_substring": FIND, "find_kind_page": FIND_KIND, "symbol_summary": SUMMARY, "point_get_fresh": FRESH, "nocase_lookup": NOCASE,
    "symbol_exists": EXISTS, "edge_predicates": EDGE_PREDICATES, "path_guard": GUARD, "search_terms": TERMS, "task_identifiers": IDENTIFIERS,
    "creation_targets": CREATION, "edit_targets": EDIT, "identifier_key": KEY, "external_identifiers": EXTERNAL, "task_profile": PROFILE,
    "task_intent": INTENT, "code_task_gate": GATE, "test_path_flags": PATHS, "file_records": RECORDS, "focused_lines": FOCUSED,
}
