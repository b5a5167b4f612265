"""Steps that once fell on one task, one executor's memory or all pairs."""

from pyspark.sql import functions as F

from tessera.sources import python_parser


def test_parse_deals_files_of_one_partition(spark):
    """A table in one partition is parsed by all tasks, with the same fragments."""
    files = spark.range(0, 64, 1, 1).select(
        F.concat(F.lit("a/m"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit("h").alias("hash"), F.concat(F.lit("x = "), F.col("id").cast("string")).cast("binary").alias("content")
    )
    rows = python_parser.parse(files).select("path", F.size("symbols").alias("n"), F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in rows}) > 1
    assert sorted(r.path for r in rows) == sorted(f"a/m{i}.py" for i in range(64)) and all(r.n == 1 for r in rows)


def test_inside_is_the_order_of_ast_walk():
    import ast

    tree = ast.parse("class A:\n    xs = [1, (2, 3)]\n    def f(self, *a, k=1):\n        ys = {1: 2}\n        return [q for q in ys if q > k]\n")
    assert list(map(id, python_parser.inside(tree))) == list(map(id, ast.walk(tree)))


def test_a_crowd_of_links_takes_little_memory():
    """leaves of linked pairs were gathered for a whole strip of pairs at once."""
    import tracemalloc

    import numpy as np

    from tessera.llm import embedding_dedup as e

    n, rng = 1500, np.random.default_rng(3)
    x = np.ones((n, 16)) + 1e-3 * rng.standard_normal((n, 16))
    x[-3:] = np.eye(16)[:3]  # alone
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.sort(rng.integers(0, 5000, (n, 60)), axis=1)
    keys[:, 30] = 2500  # the common leaf
    tracemalloc.start()
    links, low = e.block_links(x, np.zeros(n, int), True, 0.98, np.sort(keys, axis=1), np.ones(n, np.int64), 2500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
    own = [set(k[k < 2500]) for k in keys]
    assert all(links[i] == sum(j != i and not own[i] & own[j] for j in range(n - 3)) for i in range(0, n - 3, 300))
    assert (low[: n - 3] == 0).all() and list(low[-3:]) == [n - 3, n - 2, n - 1] and not links[-3:].any()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_symbols_need_no_exchange_of_pairs(spark):
    """pairs of tasks and symbols were made distinct by a shuffle; ids that repeat still give one row."""
    from tessera.operators import lookup

    tasks = spark.createDataFrame([(1, "fix a_b and x.a_b"), (2, "see x.a_b"), (3, "see y.a_b"), (4, None)], "task_id int, text string")
    rows = [("f::a_b", "a_b", "x.a_b"), ("f::a_b", "a_b", None), ("f::a_b", "A_B", "z"), ("g::y.a_b", "a_b", "q"), ("n", None, "x.a_b"), ("f::a_b", "c_d", "c_d")]
    out = lookup.exact_symbols(tasks, spark.createDataFrame(rows, "id string, name string, qualname string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "f::a_b"), (1, "g::y.a_b"), (2, "f::a_b"), (3, "g::y.a_b")]
    single = _plan(out).split("Union")[1].split("HashAggregate")[0]
    assert "BroadcastHashJoin" in single


def test_tasks_of_one_text_are_met_once(spark, tmp_path):
    """what is joined grows with the distinct texts, and every task has its row."""
    from tessera.operators import graph, lookup
    from tessera.plans import graph_queries, search_queries

    part = spark.createDataFrame([(k, "small ring", "Brand#1", "ECONOMY", 50 if k % 8 else 1, 1.0) for k in range(64)], "p_partkey long, p_name string, p_brand string, p_type string, p_size long, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    met, real = [], (graph.relevant_tests, lookup.exact_symbols)
    try:
        graph.relevant_tests = lambda m, *a: met.append(m.count()) or real[0](m, *a)
        lookup.exact_symbols = lambda t, *a: met.append(t.count()) or real[1](t, *a)
        best, pinned = graph_queries.relevant_tests(spark, str(tmp_path)).collect(), search_queries.exact_pinning(spark, str(tmp_path)).collect()
    finally:
        graph.relevant_tests, lookup.exact_symbols = real
    assert met == [56, 8]  # one text against 56 tests, eight texts
    assert len(best) == 128 and {r.task_id for r in best} == set(range(64)) and {r.task_id for r in pinned} == set(range(64))


def test_documents_of_one_partition_are_cut_by_all_tasks(spark):
    """texts of one partition were cut into terms by one task."""
    from tessera.operators import search

    s = spark.range(0, 64, 1, 1).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"), F.lit("q").alias("qualname"), F.lit("p").alias("path"), F.lit(False).alias("is_test"), F.lit("some words").alias("source"))
    rows = search.documents(s).select("id", "body_terms", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in rows}) > 1 and len(rows) == 64 and all(r.body_terms == ["some", "words"] for r in rows)


def test_packs_are_folded_outside_the_interpreter_of_expressions(spark):
    """a fold of nested lambdas counted each overlap a dozen times, and each round of choices all of them again."""
    from tessera.operators import pack

    rows = [
        (1, "a", "caller", 1, 40, ["x", "y"], 100), (1, "b", "caller", 2, 40, ["x", "y"], 100), (1, "c", "test", 1, 4000, ["z"], 100), (1, "d", "test", 2, 10, None, 100), (1, "e", "dependency", 1, None, ["q"], 100),
        (2, "f", "declaration", 1, 40, [], None), (3, "g", "else", 1, 1, [], 1), (4, "h", "caller", 1, 500, ["x"], 0), (4, "i", "caller", 2, 500, ["y", "x"], 0),
    ]
    out = pack.frontier(spark.createDataFrame(rows, "task_id int, id string, role string, ord int, bytes int, terms array<string>, used int"), 800)
    got = {(r.task_id, r.id): r.state for r in out.collect()}
    assert got == {(1, "e"): "omitted", (1, "c"): "omitted", (1, "d"): "included", (1, "a"): "included", (1, "b"): "pruned", (2, "f"): "omitted", (4, "h"): "included", (4, "i"): "pruned"}
    assert "MapInArrow" in _plan(out) and "aggregate(" not in _plan(out)


def test_texts_that_many_candidates_name_are_cut_once(spark):
    """outlines and sources were cut into terms again for every candidate."""
    from tessera.operators import pack

    s = spark.createDataFrame([("a", "one two  \n", None, "node", "A", "h"), ("b", None, "def b(x)", "node", "B", "i"), ("b", "dup", None, None, "B", None)], "id string, source string, signature string, kind string, qualname string, hash string")
    c = spark.createDataFrame([(t, i, 1.0, "test", d) for t in (1, 2) for i in ("a", "b", "gone") for d in ("full", "outline")], "task_id int, id string, score double, role string, detail string")
    plain, once = pack.render(c, s), pack.render(c, s, once=True)
    assert set(plain.columns) == set(once.columns)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(plain) == rows(once) and len(rows(once)) == 12


def test_symbols_of_one_name_meet_tasks_two_at_a_time(spark):
    """each task met all symbols of its name; the best two are those of the whole order, dotted names included."""
    from tessera.operators import search

    rows = [(f"s{i:03d}", "ring", f"K.ring.{i % 9}" if i % 3 else "K.Ring", f"p{i % 4}/lib", i % 5 == 0, "c" if i % 2 else "python", "int f(void);" if i % 7 else "f") for i in range(200)]
    rows += [rows[3], ("t1", "Ring", None, "p1/lib", False, "c", "f"), ("t2", None, "K.ring", "p0", False, None, None), ("s005", "ring", "other.K.Ring", "p0/lib", None, None, None)]
    symbols = spark.createDataFrame(rows, "id string, name string, qualname string, path string, is_test boolean, language string, source string")
    tasks = spark.createDataFrame([(1, "what of Ring_a and RING?"), (2, "see K.ring"), (3, "see other.K.ring and RING in p2"), (4, "see Z.K.ring"), (5, None)], "task_id int, text string")
    met = []
    real = search.shared.top
    try:
        search.shared.top = lambda df, by, *a: met.append(df) or real(df, by, *a) if by == ["task_id"] else real(df, by, *a)
        best = sorted(tuple(r) for r in search.exact_definitions(tasks, symbols).collect())
    finally:
        search.shared.top = real
    assert best == [(1, "s002", 1), (1, "s004", 2), (2, "s005", 1), (3, "s002", 1), (3, "s004", 2)]
    assert met[0].where("task_id = 1").count() < 40


def test_short_symbols_stand_for_all_of_their_name(spark):
    """each text met every symbol of a name that it holds; an owner that is ruled out does not cost a place."""
    from tessera.operators import search

    rows = [(f"f/x::a.b.c{i:02d}", "f", "word", "word other " + "y" * i + (";" if i % 2 else "")) for i in range(30)] + [("f/x::a", "f", "word", ""), ("f/x::a.b", "f", "word", ""), ("f/x::a.b", "f", "word", ""), ("g", "g", "word", ";")]
    symbols = spark.createDataFrame(rows, "id string, path string, name string, source string")
    out = search.nearby_symbols(spark.createDataFrame([(1, "f/x::a.b.c00"), (2, "f/x::a.b.c01"), (3, "g")], "task_id int, id string"), symbols)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "f/x::a.b.c01", "dependency", 1), (1, "f/x::a.b.c02", "dependency", 2), (1, "g", "declaration", 1), (2, "f/x::a.b.c00", "dependency", 1), (2, "f/x::a.b.c02", "dependency", 2), (2, "g", "declaration", 1), (3, "f/x::a.b.c01", "declaration", 1)]
    assert any("shortest-names" in path for path in out.inputFiles())


def test_long_texts_of_a_group_take_little_memory():
    """op7_ngram_join: the hashes of a whole group were sorted at once."""
    import tracemalloc

    import numpy as np

    from tessera.llm import ngram_join as j

    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 64, 400_000, np.uint64))
    sets = [np.unique(rng.choice(pool, 20_000)) for _ in range(300)] + [pool[:0], pool[:1], pool[-1:], np.array([0, 2**64 - 1], np.uint64)]
    left, right = np.arange(0, 304, 2), np.arange(1, 304, 2)
    tracemalloc.start()
    got = j.overlaps(sets, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    assert all(got[a, b] == len(np.intersect1d(sets[left[a]], sets[right[b]])) for a, b in [(0, 0), (17, 140), (150, 151), (151, 150), (151, 151), (150, 3)])


def test_documents_of_common_terms_are_ranked_once_for_tasks_that_share_them(spark, sf):
    """with common terms ranked by sets the best documents are those of all pairs, and pairs do not multiply."""
    from tessera.operators import search
    from tessera.plans import bindings as b

    parts = b.parts(spark, sf).withColumn("source", F.concat(F.col("name"), F.lit(" everywhere"), F.when(F.col("p_partkey") % 3 == 0, " thrice").otherwise("")))
    text = F.concat(F.lit("everywhere thrice "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, " nothing").otherwise(""))
    tasks = parts.select(F.col("p_partkey").alias("task_id"), text.alias("text"))
    docs = search.documents(parts)
    n, limit = parts.count(), 7
    plain = search.bm25(tasks, docs, limit, common=n).collect()
    assert sorted(search.bm25(tasks, docs, limit, common=5).collect()) == sorted(plain) and len(plain) == n * limit
    at = search.index(tasks, docs)
    df = at.hits.groupBy("term").count()
    weights = at.asked.join(df, "term").select("task_id", "term", F.lit(1.0).alias("idf"), F.lit(9.0).alias("avg_dl"), (F.col("count") > 5).alias("common"))
    sets = weights.where("common").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("set"))
    assert search._scored_by_sets(at.hits, weights, sets, limit).count() <= n * (limit + 5) < n * n


def test_dotted_names_meet_only_symbols_of_that_spelling(spark):
    """a dotted name met every symbol of its leaf; a pair by two of a task's names still comes once."""
    from tessera.operators import lookup

    symbols = spark.createDataFrame([(f"m.py::Box{i}.grow", "grow", f"Box{i}.grow") for i in range(9)] + [("m.py::grow", "grow", "grow")], "id string, name string, qualname string")
    tasks = spark.createDataFrame([(1, "modify Box1.grow"), (2, "modify Box1.grow and Box2.grow"), (3, "modify Nowhere.grow"), (4, "call grow() of Box3.grow")], "task_id int, text string")
    found = lookup.exact_symbols(tasks, symbols)
    assert sorted(map(tuple, found.where("task_id < 4").collect())) == [(1, "m.py::Box1.grow"), (2, "m.py::Box1.grow"), (2, "m.py::Box2.grow")]
    assert found.where("task_id = 4").count() == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan


def test_pairs_of_tasks_and_documents_need_no_exchange(spark):
    """pairs were exchanged by task and document; hits are dealt by document instead, and pairs stay there."""
    from tessera.operators import search

    hits = spark.createDataFrame([("a", "x", 3, 0, 1), ("a", "y", 3, 0, 2), ("b", "x", 1, 1, 0)], "id string, term string, dl int, tf_identity long, tf_body long")
    weights = spark.createDataFrame([(1, "x", 1.0, 2.0), (1, "y", 2.0, 2.0), (2, "y", 2.0, 2.0)], "task_id int, term string, idf double, avg_dl double")
    scored = search._scored(hits, weights, "task_id")
    assert sorted((r.task_id, r.id) for r in scored.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(task_id" not in plan


def test_attributes_are_spelled_as_unparse_does():
    """every name and attribute was written out by unparse."""
    import ast

    for code in ("a", "a.b.c", "f(x).y", "1 .real", "(a + b).c.d", "'s'.join", "[x][0].y.z", "(yield_).a", "(lambda: a).b"):
        node = ast.parse(code, mode="eval").body
        assert python_parser.spelled(node) == ast.unparse(node)


def test_exact_evidence_cuts_names_once_and_parses_sources_only(spark):
    """names were cut out of each task three times, by one task of Spark, and outlines, loads and edges came for nothing."""
    from tessera.functions import text
    from tessera.plans import decide

    body = "import os\nX = [1]\nclass Box:\n    @property\n    def size(self):\n        return os.sep\n    @size.setter\n    def size(self, v):\n        def inner(): pass\nif X:\n    def late_one(a=f(1)):\n        return g(a)\n"
    files = spark.createDataFrame([("a.py", "python", "h", body.encode()), ("b.py", "python", "i", b"def broken(:"), ("c.py", "python", "j", b"def f(): pass\ndef f(): pass\n")], "path string, language string, hash string, content binary")
    brief, whole = ({r.path: r for r in python_parser.parse(files.withColumn("details", F.lit(d))).collect()} for d in (False, True))
    same = ["id", "name", "qualname", "kind", "start", "end", "source", "parent", "is_test"]
    for path, n in (("a.py", 6), ("b.py", 0), ("c.py", 0)):
        assert [[s[c] for c in same] for s in brief[path].symbols] == [[s[c] for c in same] for s in whole[path].symbols] and len(brief[path].symbols) == n
        assert brief[path].diagnostics == whole[path].diagnostics and len(brief[path].diagnostics) == (n == 0) and not brief[path].edges
        assert brief[path].imports == whole[path].imports and all(s.outline is None for s in brief[path].symbols)
    assert whole["a.py"].symbols[0].literals == {"X": 1} and whole["a.py"].imports[0].bound == {"os": "os"} and whole["a.py"].edges
    tasks = spark.createDataFrame([(1, "what does late_one return?", 2200), (2, "hello", 2200), (3, None, 2200), (4, "compare late_one and Box.size", 2200)], "task_id int, text string, budget int")
    calls, real = [], text.task_identifiers
    try:
        text.task_identifiers = lambda c: calls.append(c) or real(c)
        rows = {r.task_id: r for r in decide.exact_evidence(tasks, files).collect()}
    finally:
        text.task_identifiers = real
    assert len(calls) == 1
    assert set(rows) == {1, 4} and rows[1].ids == ["a.py::late_one"] and rows[1].missing == [] and rows[4].ids == ["a.py::Box.size", "a.py::late_one"]


def test_documents_are_cut_and_counted_in_one_pass(spark):
    """Each word was a row that an exchange counted; terms are those of the expression, ids that repeat add up."""
    import random
    import re

    from tessera.operators import search

    rng = random.Random(4)
    letters = "abAB01_ -.çÇİK中文字\n𝒜é"
    rows = [(f"d{i % 90}", rng.choice(["fooBar", "a", None, "中文x"]), "q.Q", f"p/{i % 3}", "".join(rng.choices(letters, k=rng.randrange(60))) if i % 9 else None) for i in range(100)]
    s = spark.createDataFrame([*rows, rows[0], (None, "n", None, None, "null id"), (None, "n", None, None, "null id")], "id string, name string, qualname string, path string, source string").withColumn("is_test", F.lit(False))
    docs = search.documents(s)
    entry = lambda c, i: docs.select("id", "dl", F.explode(c).alias("term"), F.lit(i).alias("i"))
    flat = entry("name_terms", 2).unionByName(entry("identity_terms", 1)).unionByName(entry("body_terms", 0)).unionByName(docs.select("id", "dl", F.lit("").alias("term"), F.lit(0).alias("i")))
    want = flat.groupBy("id", "term", "dl").agg(F.count_if(F.col("i") == 1), F.count_if(F.col("i") == 0), F.max("i") == 2)
    got = search.postings(docs)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    single = search.postings(search.documents(s.where("id > 'd2'").dropDuplicates(["id"])), spark.createDataFrame([("foo",)], "term string"))
    assert {r.term for r in single.collect()} == {"", "foo"}
    assert not re.search(r"hashpartitioning\(id[^)]*term", _plan(single))


def test_few_tasks_are_scored_by_one_product(spark):
    """every pair of a task and a document was a row; ties at the last place, documents cut by batches and null ids count."""
    from tessera.operators import search

    rows = [(f"d{i:03d}" if i else None, t, 3 + i % 5, i % 2, 1 + (i * len(t)) % 4) for i in range(120) for t in ("x", "yy", "zzz", "w")[i % 4 :]]
    hits = spark.createDataFrame([*rows, rows[5], ("u", "alone", 1, 1, 1)], "id string, term string, dl int, tf_identity long, tf_body long")
    weights = spark.createDataFrame([(k, t, 0.1 + i, 4.0) for k in (7, 8, 9) for i, t in enumerate(("x", "yy", "zzz", "w")) if (k + i) % 3], "task_id int, term string, idf double, avg_dl double")
    top = lambda df: sorted(map(str, map(tuple, search.shared.top(df, ["task_id"], [F.desc("score"), F.col("id")], 6).select("task_id", "id", "score", "rank").collect())))
    want = top(search._scored(hits, weights, "task_id"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = search.CELLS
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        search.CELLS = 8
        tf = 8.0 * F.col("tf_identity") + F.col("tf_body")
        met = search._leading(hits.select("id", "term", (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / 4.0))).alias("part")), weights, 6)
        few = met.where("n is null")
        assert {r.task_id: r.n for r in met.groupBy("task_id").agg(F.sum("n").alias("n")).collect()} == {r.task_id: r["count"] for r in search._scored(hits, weights, "task_id").groupBy("task_id").count().collect()}
        assert top(few) == want and len(want) == 18
    finally:
        search.CELLS = cells
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert few.count() < search._scored(hits, weights, "task_id").count()


def test_all_symbols_are_ranked_without_a_row_a_pair(spark):
    """F16: each pair of a task and a symbol was a row that was exchanged twice; rows, totals and evidence are the same."""
    from tessera.operators import search

    rows = [(f"p/{i}::{n}", n, f"Q.{n}", f"p/{i % 3}", i % 4 == 0, f"word{i % 5} common {'test ' * (i % 2)}{i}") for i, n in enumerate(["grow", "fooBar", "a_b", "la", "x"] * 9)]
    symbols = spark.createDataFrame([*rows, ("last", None, None, None, None, None)], "id string, name string, qualname string, path string, is_test boolean, source string")
    tasks = spark.createDataFrame([(1, "why does fooBar and Q.fooBar fail in word3"), (2, "la common test of a_b"), (3, "nothing here"), (4, None), (5, "common word1 word2 grow()")], "task_id int, text string")
    docs, met, real, few = search.documents(symbols), [], search._leading, search.FEW
    ranked = lambda: sorted(map(str, (r.asDict(True) for r in search.rank_all(tasks, symbols, docs, 7).select("task_id", "id", "score", "evidence", "total", "rank").collect())))
    try:
        search._leading = lambda *a: met.append(1) or real(*a)
        got = ranked()
        search.FEW = -1
        assert got == ranked() and len(got) > 14 and len(met) == 1
    finally:
        search._leading, search.FEW = real, few
