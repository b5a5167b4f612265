"""Queries of answer rules, definitions by name, an edit's surroundings, receipts and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, pack, search, shared, stats
from ..sources import python_parser as parser
from . import bindings as b
from . import source_queries, transactions

_BY_RULE = {
    "exact": ("o_orderpriority", "CASE WHEN k % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END"),
    "number_sequence": ("concat('a 12 b ', k)", "CASE WHEN k % 5 = 0 THEN concat('12,', k + 1) ELSE concat('12 and ', k) END"),
    "numeric_sequence": ("concat('-1.50 and ', k)", "CASE WHEN k % 5 = 0 THEN concat('-1.5, ', k, '.0') ELSE concat('1.5 ', k) END"),
    "labeled_sequence": ("concat('a=1|b=', k)", "CASE WHEN k % 4 = 0 THEN concat('1 | x = ', k) ELSE concat('2|', k) END"),
    "path_categories": ("''", "CASE WHEN k % 4 = 0 THEN 'An ABSOLUTE path, internal state, a symlink' ELSE 'absolute, internal' END"),
    "ast_type_sequence": ("'ast.Call, ast.Name'", "CASE WHEN k % 4 = 0 THEN 'call,name' ELSE 'call,attribute' END"),
}
_case = lambda i: "CASE " + " ".join(f"WHEN k % 6 = {n} THEN {x[i]}" for n, x in enumerate(_BY_RULE.values())) + " END"
_RULE = "CASE " + " ".join(f"WHEN k % 6 = {n} THEN '{x}'" for n, x in enumerate(_BY_RULE)) + " END"
_ANSWERS = f"SELECT k AS task_id, {_RULE} AS rule, {_case(0)} AS expected, CASE WHEN k % 11 = 0 THEN NULL ELSE {_case(1)} END AS observed FROM"


def answer_rules(spark, sf):
    """Every order is a task; its priority, status and key make the expected and the observed answer."""
    o = b.table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    a = o.selectExpr("k AS task_id", f"{_RULE} AS rule", f"{_case(0)} AS expected", f"CASE WHEN k % 11 = 0 THEN NULL ELSE {_case(1)} END AS observed")
    return a.select("task_id", "rule", answers.semantic_match(F.col("rule"), F.col("expected"), F.col("observed")).alias("success"))


_NUMBERS = r"list_transform(regexp_extract_all({}, '-?\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))".format
_VALUES = "list_transform(string_split({}, '|'), lambda x: trim(string_split(x, '=')[-1]))".format
ANSWER_RULES = rf"""WITH a AS ({_ANSWERS} (SELECT o_orderkey AS k, * FROM orders))
SELECT task_id, rule, coalesce(CASE rule WHEN 'number_sequence' THEN regexp_extract_all(observed, '\d+') = regexp_extract_all(expected, '\d+') WHEN 'numeric_sequence' THEN {_NUMBERS('observed')} = {_NUMBERS('expected')}
WHEN 'labeled_sequence' THEN {_VALUES('observed')} = {_VALUES('expected')} WHEN 'path_categories' THEN contains(lower(observed), 'absolute') AND contains(lower(observed), 'internal') AND contains(lower(observed), 'symlink')
WHEN 'ast_type_sequence' THEN replace(replace(lower(observed), 'ast.', ''), ' ', '') = replace(replace(lower(expected), 'ast.', ''), ' ', '') ELSE observed = expected END, false) AS success FROM a"""


def rubric_answers(spark, sf):
    p = b.table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    final = F.expr("CASE WHEN k % 7 = 0 THEN concat('no mark ', k) WHEN k % 5 = 0 THEN concat('<answer>Foo  baz | it</answer>') ELSE concat('<answer> Foo  BAR ', k, ' | it &amp; that</answer>\n') END")
    rubric = F.expr(r"CASE k % 3 WHEN 1 THEN array('foo\\s+bar', 'that$') WHEN 2 THEN array('^foo bar \\d+$', 'it & th.t') END")
    seen = answers.read_answer(final)
    return p.select(F.col("k").alias("task_id"), answers.rubric_match(seen, rubric, F.col("k") % 3 == 1, F.expr("concat('foo bar ', k, ' | it & that')")).alias("success"))


RUBRICS = "SELECT p_partkey AS task_id, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS success FROM part"


def normalized_returns(spark, sf):
    p = b.table(spark, sf, "part")
    source = F.expr("concat('x = 1\ndef f_', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '(a)' ELSE '()' END, ':  \n    return  ', p_size, '   +  1 \nreturn 2\n')")
    return p.select("p_partkey", answers.normalized_return(source, F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))).alias("returned"))


RETURNS = "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size || ' + 1' END AS returned FROM part"


def derived_facts(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"))
    body = F.concat(F.lit("ITEMS_"), "k", F.lit(" = ["), F.expr("repeat('1, ', cast(p_partkey % 5 as int))"), F.lit("]\n"))
    path = F.concat(F.lit("m_"), "k", F.lit(".py"))
    files = p.select(path.alias("path"), F.lit("python").alias("language"), F.sha2(body, 256).alias("hash"), body.cast("binary").alias("content"))
    tasks = p.select(F.col("p_partkey").alias("task_id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "How many entries has Items_").otherwise("show Items_"), "k", F.lit("?")).alias("text"))
    anchors = p.select(F.col("p_partkey").alias("task_id"), F.concat(path, F.lit("::ITEMS_"), "k").alias("id"))
    return answers.derived_facts(tasks, anchors, parser.symbols(parser.parse(files)))


FACTS = "SELECT p_partkey AS task_id, 'ITEMS_' || p_partkey || ' cardinality = ' || (p_partkey % 5) AS fact FROM part WHERE p_partkey % 2 = 0"


def imports_blocks(spark, sf):
    fragments = shared.written(parser.parse(source_queries._files(spark, sf)), "fragments")
    symbols = parser.symbols(fragments)
    mine = parser.relevant_imports(symbols, parser.imports(fragments)).withColumnRenamed("id", "task_id")
    return pack.imports_block(symbols.select(F.col("id").alias("task_id"), F.octet_length("source").alias("used")), mine, 120)


IMPORTS_BLOCKS = f"""WITH {source_queries._K}, s AS (SELECT k, chr(10) || '# imports' || chr(10) || 'import os' || chr(10) || 'from lib_' || k || ' import helper_' || k || chr(10) AS block,
 octet_length(encode('def test_use():' || chr(10) || '    return helper_' || k || '(len(os.sep))' || chr(10))) AS used FROM k WHERE k % 50 <> 0)
SELECT 'pkg/tests/use_' || k || '.py::test_use' AS task_id, block, CAST(octet_length(encode(block)) AS INTEGER) AS bytes, used + octet_length(encode(block)) <= 120 AS included FROM s"""


def receipt_ids(spark, sf):
    p = b.table(spark, sf, "part")
    return pack.receipt_ids(p.select((F.col("p_partkey") % 100).alias("task_id"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("id"), F.sha2("p_name", 256).alias("hash")))


RECEIPTS = """SELECT p_partkey % 100 AS task_id, substr(sha256('{' || string_agg('"p/' || p_partkey || '": "' || sha256(p_name) || '"', ', ' ORDER BY 'p/' || p_partkey) || '}'), 1, 24) AS receipt FROM part GROUP BY 1"""


def exact_definitions(spark, sf):
    p = b.parts(spark, sf).join(b.table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey")
    k = F.col("p_partkey")
    path = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")), F.when(k % 4 == 0, "/vendor").otherwise(""))
    symbols = p.select("id", "name", "qualname", path.alias("path"), "is_test", F.when(k % 2 == 0, "c").otherwise("python").alias("language"), F.when(k % 3 == 0, "int f(void);").otherwise("f").alias("source"))
    return search.exact_definitions(b.prompts(spark, sf), symbols)


def _definitions() -> str:
    from .lookup_queries import _IDENT

    return f"""WITH {b.PARTS}, {b.PROMPTS}, {_IDENT}, t AS (SELECT task_id, count(*) AS n FROM code GROUP BY task_id),
s AS (SELECT id, name, qualname, is_test, replace(lower(p_type), ' ', '/') || CASE WHEN p_partkey % 4 = 0 THEN '/vendor' ELSE '' END AS path, p_partkey % 4 = 0 AS vendor, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AS declaration FROM parts JOIN part USING (p_partkey)),
m AS (SELECT DISTINCT code.task_id, s.*, t.n FROM code JOIN t ON t.task_id = code.task_id JOIN s ON lower(leaf) = lower(name) WHERE NOT contains(v, '.') OR lower(qualname) = lower(v) OR ends_with(lower(qualname), '.' || lower(v))),
r AS (SELECT m.task_id, id, n, row_number() OVER (PARTITION BY m.task_id ORDER BY is_test, vendor, declaration, len(list_filter(list_distinct(string_split(path, '/')), lambda p: length(p) >= 3 AND contains(lower(text), p))) DESC, len(string_split(path, '/')), id) AS place
 FROM m JOIN prompts ON prompts.task_id = m.task_id)
SELECT task_id, id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2 AND (n > 1 OR place = 1)"""


_PATH = "concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR))"


def _files(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def reference_windows(spark, sf):
    """Each benchmark passage names a word that other documents use."""
    from ..functions import text

    files = _files(spark, sf)
    targets = b.tasks(spark, sf).join(files.select(F.col("doc_id").alias("task_id"), "path"), "task_id").select("task_id", "path", F.get(text.search_terms(F.col("text")), 2).alias("name"))
    return search.reference_windows(targets, files.select("path", "text"))


WINDOWS = f"""WITH f AS (SELECT doc_id, {_PATH} AS path, coalesce(text, '') AS text FROM documents),
t AS (SELECT item_id AS task_id, path AS own, ({b.terms_sql('benchmark.text')})[3] AS leaf FROM benchmark JOIN f ON doc_id = item_id),
w AS (SELECT path, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS leaf FROM f),
h AS (SELECT task_id, leaf, path, regexp_matches(lower(path), 'test|spec|testing') AS is_test, regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(own, '^(.*)/[^/]*$', 1) AS near FROM w JOIN t USING (leaf) WHERE path <> own),
r AS (SELECT *, CASE WHEN is_test THEN 0 WHEN near THEN 1 ELSE 2 END AS kind FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind ORDER BY NOT near, len(string_split(path, '/')), lower(path), path) AS rank FROM r QUALIFY rank <= CASE kind WHEN 0 THEN 6 ELSE 4 END),
p AS (SELECT *, row_number() OVER (PARTITION BY task_id, is_test ORDER BY kind, rank) AS i FROM q QUALIFY i <= CASE WHEN is_test THEN 2 ELSE 1 END),
l AS (SELECT task_id, is_test, p.path, leaf, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM p JOIN f ON f.path = p.path),
a AS (SELECT *, list_position(list_transform(lines, lambda x: list_contains(regexp_extract_all(lower(x), '[a-z0-9_]+'), leaf)), true) - 1 AS pos FROM l)
SELECT task_id, CASE WHEN is_test THEN 'test' ELSE 'caller' END AS role, path, CAST(pos + 1 AS INTEGER) AS line, CAST(greatest(0, pos - 6) + 1 AS INTEGER) AS first, CAST(least(len(lines), pos + 7) AS INTEGER) AS last,
array_to_string(lines[greatest(0, pos - 6) + 1 : least(len(lines), pos + 7)], chr(10)) AS source FROM a WHERE pos >= 0"""


def nearby_symbols(spark, sf):
    """Every document's own first word names it; its text names those of its folder."""
    s = b.symbols(spark, sf).withColumn("source", F.coalesce("source", F.lit("")))
    return search.nearby_symbols(s.select(F.col("doc_id").alias("task_id"), "id"), s)


NEARBY = f"""WITH {b.SYMBOLS}, s AS (SELECT doc_id, id, path, name, coalesce(source, '') AS source FROM symbols),
t AS (SELECT doc_id AS task_id, id AS target, path, unnest(list_distinct(regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))) AS name FROM s),
n AS (SELECT task_id, id, row_number() OVER (PARTITION BY task_id ORDER BY length(source), id) AS place FROM t JOIN s USING (path, name) WHERE length(name) >= 3 AND id <> target AND NOT starts_with(target, id || '.') QUALIFY place <= 2),
d AS (SELECT a.doc_id AS task_id, z.id, row_number() OVER (PARTITION BY a.doc_id ORDER BY length(z.source), z.id) AS place FROM s a JOIN s z ON lower(a.name) = lower(z.name) AND a.id <> z.id WHERE ends_with(trim(z.source), ';') QUALIFY place <= 1)
SELECT task_id, id, 'dependency' AS role, CAST(place AS INTEGER) AS place FROM n UNION ALL SELECT task_id, id, 'declaration', CAST(place AS INTEGER) FROM d"""


def mcnemar_change(spark, sf):
    r = b.runs(spark, sf)
    side = lambda g: F.bool_or(F.when(F.col("group") == g, F.col("success")))
    pairs = r.groupBy("task_id", "level").agg(side("baseline").alias("baseline"), side("treatment").alias("treatment")).where("baseline is not null and treatment is not null")
    return stats.mcnemar(pairs, ["level"])


MCNEMAR = f"""WITH {b.RUNS}, p AS (SELECT task_id, level, bool_or(success) FILTER (WHERE "group" = 'baseline') AS a, bool_or(success) FILTER (WHERE "group" = 'treatment') AS z FROM runs GROUP BY task_id, level),
c AS (SELECT level, count(*) AS pairs, count(*) FILTER (WHERE a AND NOT z) AS lost, count(*) FILTER (WHERE z AND NOT a) AS won FROM p WHERE a IS NOT NULL AND z IS NOT NULL GROUP BY level)
SELECT *, round(CAST(pow(greatest(abs(lost - won) - 1, 0), 2) AS DOUBLE) / nullif(CAST(lost + won AS DOUBLE), 0), 6) AS statistic FROM c"""


def _log(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    k, step = F.col("doc_id"), F.col("seq")
    each = d.withColumn("seq", F.explode(F.sequence(F.lit(0), (k % 3).cast("int")))).withColumn("path", F.concat(F.lit("f/"), k.cast("string")))
    at = lambda n: F.concat("t", F.lit("#"), n.cast("string"))
    return each.select(step.cast("int").alias("seq"), "path", at(step).cast("binary").alias("before"), F.sha2(at(step), 256).alias("hash_before"), at(step + 1).cast("binary").alias("content"), F.sha2(at(step + 1), 256).alias("hash_after"), "doc_id", "t")


def transaction_states(spark, sf):
    """What each file of a change log was and became: every document is changed one to three times."""
    return transactions.last_states(_log(spark, sf)).select("path", "hash_before", "hash_after", F.size("hashes").alias("known"))


def transaction_conflicts(spark, sf):
    """Files of the log that are now something else: every seventh was changed from outside, every fifth is gone."""
    log = _log(spark, sf)
    k = F.col("doc_id")
    now = log.where("seq = 0 and doc_id % 5 <> 0").select("path", F.sha2(F.concat("t", F.when(k % 7 == 0, "!").otherwise(F.concat(F.lit("#"), (k % 2).cast("string")))), 256).alias("hash"))
    return transactions.outside_changes(log, now)


_T = "SELECT doc_id, 'f/' || doc_id AS path, coalesce(text, '') AS t FROM documents"
STATES = f"SELECT path, sha256(t || '#0') AS hash_before, sha256(t || '#' || (doc_id % 3 + 1)) AS hash_after, CAST(doc_id % 3 + 2 AS INTEGER) AS known FROM ({_T})"
CONFLICTS = f"SELECT path FROM ({_T}) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0"

QUERIES = {
    f.__name__: f
    for f in (
        answer_rules, rubric_answers, normalized_returns, derived_facts, imports_blocks, receipt_ids, exact_definitions, reference_windows, nearby_symbols, mcnemar_change, transaction_states, transaction_conflicts,
    )
}
ORACLES = {
    "answer_rules": ANSWER_RULES, "rubric_answers": RUBRICS, "normalized_returns": RETURNS, "derived_facts": FACTS, "imports_blocks": IMPORTS_BLOCKS, "receipt_ids": RECEIPTS, "exact_definitions": _definitions(),
    "reference_windows": WINDOWS, "nearby_symbols": NEARBY, "mcnemar_change": MCNEMAR, "transaction_states": STATES, "transaction_conflicts": CONFLICTS,
}
