"""Results that took more room or steps than they need."""

from pathlib import Path

from pyspark.sql import functions as F


def test_pairs_of_names_take_little_room(spark, tmp_path):
    """pairs of tasks and symbols were put out with names by turns, so that one was stored like noise."""
    from tessera.operators import lookup

    names = F.array(*(F.lit(f"part_{c}") for c in "abcdefgh"))
    tasks = spark.range(2400).select("id", F.concat(F.lit("see "), F.get(names, F.col("id") % 8)).alias("text")).withColumnRenamed("id", "task_id")
    symbols = spark.range(2400).select(F.concat(F.lit("f::"), F.col("id").cast("string")).alias("id"), F.get(names, F.col("id") % 8).alias("name"), F.lit(None).cast("string").alias("qualname"))
    lookup.exact_symbols(tasks, symbols).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 8 * 300 * 300
    assert sum(p.stat().st_size for p in Path(tmp_path, "pairs").glob("*.parquet")) < 8 * 300 * 300 / 2.5


def test_pairs_are_whole_by_pieces(spark, monkeypatch):
    """names of one piece and of several, tasks without a number, names that nobody has or asks for."""
    from tessera.operators import lookup

    monkeypatch.setattr(lookup, "PIECE", 4)
    tasks = [(k, f"see a_{k % 3}") for k in range(40)] + [(None, "see a_1"), (50, "see b_b"), (51, "see z_z and a_2")]
    symbols = [(f"s{k}", f"a_{k % 3}" if k < 50 else "q_q", None) for k in range(60)] + [("t", "b_b", None), ("t", "a_2", None)]
    out = lookup.exact_symbols(spark.createDataFrame(tasks, "task_id int, text string"), spark.createDataFrame(symbols, "id string, name string, qualname string"))
    got = [tuple(r) for r in out.collect()]
    wanted = {(t, i) for t, said in tasks for i, name, _ in symbols if name in said.split()}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_arcs_are_not_exchanged(spark, monkeypatch):
    """all arcs were made distinct by a shuffle, and each round compared all of their texts."""
    from tessera.operators import graph

    kept, real = {}, graph.shared.written
    monkeypatch.setattr(graph.shared, "written", lambda df, label: kept.setdefault(label, df) and real(df, label))
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", None), (None, "c"), ("e", "f"), ("f", "f")]
    edges, starts = spark.createDataFrame(rows, "source string, target string"), spark.createDataFrame([("c",), ("f",), ("z",), ("c",)], "id string")
    wanted = {("c", i) for i in "cbad"} | {("f", "f"), ("f", "e"), ("z", "z")}
    for limit in (200_000, 1):
        monkeypatch.setattr(graph.shared, "BROADCAST_ROWS", limit)
        got = [tuple(r) for r in graph.closure(edges, starts).collect()]
        assert len(got) == len(set(got)) and {p for p in got if None not in p} == wanted
    back = {tuple(r) for r in graph.closure(edges, starts, inverse=False).collect()}
    assert back == {("c", "c"), ("c", "a"), ("c", "b"), ("f", "f"), ("z", "z")}
    assert "mark" in kept["arcs"].columns and "Exchange" not in kept["arcs"]._jdf.queryExecution().executedPlan().toString()


def test_alike_models_stand_for_each_other(spark, monkeypatch):
    """a task met every symbol of a name and source, and each was scored."""
    from tessera.operators import creation

    from .test_creation import all_pairs, tables

    symbols = [(f"s{i:03d}", ["ring", "RING", "rink", "bolt"][i % 4], f"d/f{i % 5}.c", ["size", None, "memcmp"][i // 4 % 3], i % 17 == 0) for i in range(200)]
    asked = [(1, "ring_new", "a new size"), (2, "qq", "no"), (3, "bolt", "startswith prefix"), (4, None, "size")]
    want, scored, real = all_pairs(asked, symbols), [], creation._scored
    monkeypatch.setattr(creation, "_scored", lambda pairs: scored.append(pairs.count()) or real(pairs))
    first = lambda rows, n: {t: sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[1]))[:n] for t in (1, 2, 3, 4)}
    short = [tuple(r) for r in creation.best(*tables(spark, asked, symbols), 3, ties=False).collect()]
    assert first(short, 3) == first(want, 3) and set(short) <= set(want) and len(set(short)) == len(short)
    assert sum(scored) <= 4 * 9 * 3 < len(want) / 2
    low = {t: rows[-1][3] for t, rows in first(want, 3).items() if len(rows) == 3}
    full = [tuple(r) for r in creation.best(*tables(spark, asked, symbols), 3).collect()]
    assert len(set(full)) == len(full) and set(full) == {w for w in want if w[3] >= low.get(w[0], 0)}


def _exchanges(df):
    df.collect()  # the final plan
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(" Exchange ")


def test_packs_need_few_exchanges(spark, sf):
    """offers were exchanged by task and symbol and then by symbol, blocks by role and then by task."""
    from tessera.operators import pack
    from tessera.plans import pack_queries

    blocks = pack_queries._blocks(spark, sf).select("task_id", "id", "score", "role", "bytes", "terms", "required", "known")
    packs = pack.greedy(blocks, 1500)
    assert _exchanges(packs) == _exchanges(blocks) + 1
    assert _exchanges(pack_queries.frontier_pack(spark, sf)) == _exchanges(packs)
    plain = pack.render(pack_queries._anchored(spark, sf), pack_queries._nodes(spark, sf), once=True).select(blocks.columns[:6])
    rows = lambda df: sorted((r.task_id, r.id, r.score, r.role, r.bytes, tuple(r.terms)) for r in df.collect())
    assert rows(blocks) == rows(plain)


def test_tasks_of_one_file_are_dealt_before_their_rows(spark, monkeypatch):
    """one task of Spark gave all tasks of a set their best documents, as many rows as tasks times the pool."""
    from tessera.operators import search

    monkeypatch.setattr(search, "_few", lambda n: False)
    symbols = spark.range(120).select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit("n").alias("name"), F.lit("q").alias("qualname"), F.lit("p").alias("path"), F.lit(False).alias("is_test"),
        F.concat(F.lit("helper word"), (F.col("id") % 3).cast("string"), F.lit(" rare"), (F.col("id") % 50).cast("string")).alias("source"),
    )
    tasks = spark.range(0, 40, 1, 1).select(F.col("id").alias("task_id"), F.concat(F.lit("helper word"), (F.col("id") % 3).cast("string"), F.lit(" rare"), F.col("id").cast("string")).alias("text"))
    dealt, real = [], search.shared.dealt
    monkeypatch.setattr(search.shared, "dealt", lambda df, *by: dealt.append((by, df.columns)) or real(df, *by))
    at = search.index(tasks, search.documents(symbols))
    by_sets = search.bm25(tasks, None, 5, at, 20)
    assert (("task_id",), ["task_id", "set"]) in dealt
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(by_sets) == rows(search.bm25(tasks, None, 5, at)) and by_sets.count() == 200
    plan = by_sets._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert not any("hashpartitioning(task_id" in line and ", id#" in line for line in plan.splitlines())
