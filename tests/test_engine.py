"""A small source tree through scanning, parsing, resolution, retrieval, packing, edits and snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, incremental, lookup, pack, stats
from tessera.plans import pack_queries, snapshot
from tessera.plans.api import Engine
from tessera.sources import python_parser, scan

TREE = {
    "store/prices.py": 'RATES = {1, 2, 3}\n\n\ndef reduced(amount, rate):\n    """Take a rate off."""\n    if rate > 1:\n        raise ValueError(rate)\n    return amount * (1 - rate)\n\n\ndef postage(amount):\n    return 0 if amount > 50 else 5\n',
    "store/till.py": "from prices import reduced, postage\n\n\ndef total(amount, rate):\n    price = reduced(amount, rate)\n    return price + postage(price)\n",
    "store/tests/test_till.py": "import unittest\nfrom till import total\nfrom prices import reduced\n\n\nclass TillTests(unittest.TestCase):\n    def test_reduced(self):\n        self.assertEqual(reduced(10, 0.5), 5)\n\n    def test_total(self):\n        self.assertEqual(total(100, 0), 100)\n",
    "vendor/skip.py": "def skipped(): pass\n",
    "env/pyvenv.cfg": "home = x\n",
    "env/lib.py": "def skipped(): pass\n",
    "docs/readme.md": "no code\n",
    "main.go": "package main\n",
}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "src"
    for path, body in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    return root


def test_scan(spark, tree):
    rows = {r.path: r.language for r in scan.files(spark, str(tree), content=False).collect()}
    assert rows == {"store/prices.py": "python", "store/till.py": "python", "store/tests/test_till.py": "python", "main.go": "go"}
    assert {r.path for r in scan.files(spark, str(tree), ["store/tests", "*.go"]).collect()} == {"store/prices.py", "store/till.py"}


def test_parser_identities():
    code = b"""from typing import overload
class A:
    @property
    def x(self): return 1
    @x.setter
    def x(self, v): pass
    @overload
    def f(self, a: int): ...
    @overload
    def f(self, a: str): ...
    def f(self, a): return a
def outer(flag):
    if flag:
        def inner(): return 1
    else:
        def inner(): return 2
    return inner
"""
    ids = [s["qualname"] for s in python_parser.fragment("m.py", "python", code)["symbols"]]
    assert ids == ["A", "A.x", "A.x.setter", "A.f", "outer", "outer.inner", "outer.inner#local2"]
    assert python_parser.fragment("m.py", "python", b"def a(): pass\ndef a(): pass\n")["diagnostics"]
    assert python_parser.fragment("m.py", "python", b"def a(:\n")["symbols"] == []
    assert "not installed" in python_parser.fragment("m.rb", "ruby", b"")["diagnostics"][0]["error"]
    crlf = python_parser.fragment("m.py", "python", "def a():\r\n    return '漢字'\r\n".encode())["symbols"][0]
    assert crlf["source"] == "def a():\n    return '漢字'\n"
    relative = python_parser.fragment("p/q/m.py", "python", b"from ..r import s as t\n")["imports"][0]
    assert relative["module"] == "p.r" and relative["bound"] == {"t": "p.r.s"}


@pytest.fixture()
def engine(spark, tree, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index")
    e.index(str(tree))
    return e


def test_graph_of_the_tree(spark, engine):
    ids = {r.id for r in engine.symbols().collect()}
    reduced = "store/prices.py::reduced"
    assert {reduced, "store/prices.py::RATES", "store/till.py::total", "store/tests/test_till.py::TillTests.test_total"} <= ids
    one = spark.createDataFrame([(reduced,)], "id string")
    assert {r.source for r in engine.relations(one, "in", "call").collect()} == {"store/till.py::total", "store/tests/test_till.py::TillTests.test_reduced"}
    assert {r.id for r in engine.affected(one).collect()} == {"store/tests/test_till.py::TillTests.test_reduced", "store/tests/test_till.py::TillTests.test_total"}
    found = engine.find("reduced").collect()
    assert found[0].id == reduced and found[0].total == 2
    assert {r.tool for r in engine.metrics().collect()} >= {"index", "find", "relations"}


def test_context_keeps_the_budget(spark, engine):
    tasks = spark.createDataFrame([(1, "fix reduced to refuse negative rates"), (2, "what does prices.postage return"), (3, "zebra quartz")], "task_id long, text string")
    for budget in (10, 400, 4000):
        rows = engine.task_context(tasks, budget, "edit").collect()
        for task in (1, 2):
            assert sum(r.bytes for r in rows if r.task_id == task and r.state == "included") <= budget
        assert not [r for r in rows if r.task_id == 3]
    assert [r.id for r in rows if r.task_id == 1 and r.role == "task-anchor"] == ["store/prices.py::reduced"]
    state = {r.task_id: r.evidence_state for r in engine.sufficiency(spark.createDataFrame(rows)).collect()}
    assert state[1] == "sufficient"
    known = engine.symbols().where("name = 'reduced'").select("id", "hash")
    again = engine.task_context(tasks, 4000, "edit", known).collect()
    assert {r.state for r in again if r.task_id == 1 and r.role == "task-anchor"} == {"reused"}


def test_incremental_build(spark, tree, engine):
    first = engine.status()
    assert not engine.store.is_stale(str(tree))
    assert engine.index(str(tree))["index_stats"] == {"reused": 4}
    assert engine.status()["fingerprint"] == first["fingerprint"]
    (tree / "store/extra.py").write_text("def added():\n    return 1\n")
    (tree / "store/till.py").write_text("def total(:\n")
    (tree / "main.go").unlink()
    assert engine.store.is_stale(str(tree))
    second = engine.index(str(tree))
    assert second["index_stats"] == {"added": 1, "changed": 1, "deleted": 1, "reused": 2}
    till = engine.symbols().where("path = 'store/till.py'").collect()
    assert [s.name for s in till] == ["total"] and till[0].analysis_stale
    assert engine.store.table("diagnostics").where("using_last_good").count() == 1


def test_manifest_conflict(spark, engine):
    with pytest.raises(snapshot.Conflict):
        engine.store.swap("v-other", {"version": "v-new"})


def test_edits(spark, tree, engine):
    files = scan.files(spark, str(tree))
    s = {r.name: r for r in engine.symbols().collect()}
    good = "def postage(amount):\n    return 7\n"
    changes = spark.createDataFrame(
        [(s["postage"].id, s["postage"].hash, good), (s["reduced"].id, "old", good), (s["total"].id, s["total"].hash, "def other():\n    pass\n"), (s["RATES"].id, s["RATES"].hash, "RATES = 1")],
        "id string, expected_hash string, source string",
    )
    out = {r.id: r for r in snapshot.edits(files, engine.symbols(), changes).collect()}
    done = out[s["postage"].id]
    assert done.ok and b"return 7" in done.content and "+    return 7" in done.diff and b"def reduced" in done.content
    assert not any(out[s[n].id].ok for n in ("reduced", "total", "RATES"))
    table = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "1", "2")], "path string, hash_before string, hash_after string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "2")], "path string, hash string")
    assert [r.path for r in snapshot.conflicts(table, now).collect()] == ["b"]


def test_overlay_documents(spark, tmp_path, engine):
    total, postage = "store/till.py::total", "store/prices.py::postage"
    edge = {"source": total, "target": postage, "kind": "call", "line": 6, "name": "postage", "confidence": "semantic_exact"}
    doc = {"schema_version": 1, "provider": " lsp ", "index_fingerprint": engine.status()["fingerprint"], "edges": [{**edge, "confidence": "semantic_inferred"}, edge, edge]}
    (tmp_path / "overlay.json").write_text(json.dumps(doc))
    overlay = scan.overlay_edges(spark, str(tmp_path / "overlay.json"))
    merged = engine.edges(overlay, doc["index_fingerprint"]).where(F.col("target") == postage).where("kind = 'call'").collect()
    assert [(r.confidence, r.provider) for r in merged] == [("semantic_exact", "lsp")]
    stale = engine.edges(overlay, "another").where(F.col("target") == postage).where("kind = 'call'").collect()
    assert [r.confidence for r in stale] == ["static_candidate"]
    with pytest.raises(ValueError, match="invalid"):
        engine.edges(overlay.withColumn("target", F.lit("nowhere")), doc["index_fingerprint"])


def test_event_log(spark, tmp_path):
    log = tmp_path / "log"
    events = spark.createDataFrame([(1, "2024-01-01T00:00:00", "a", "enabled"), (1, "2024-01-01T00:05:00", "a", "skipped")], "schema_version int, timestamp string, host string, activation string")
    for _ in range(3):
        scan.write_events(events.coalesce(1), str(log), keep_files=2)
    (log / "part-bad.json").write_text('{"schema_version": 9}\nnot json\n')
    rows = scan.hook_events(spark, str(log))
    assert rows.count() == 4
    report = stats.hook_report(rows).first()
    assert report.activation_rate == 0.5 and report.saving is None


def test_streams(spark, tmp_path):
    from tessera.streaming import events

    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"schema_version": 1, "timestamp": f"2024-01-01T0{h}:10:00", "host": "a", "activation": "enabled", "elapsed_ms": 4.0} for h in (0, 0, 1, 3)]
    (folder / "x.json").write_text("\n".join(map(json.dumps, lines)))
    q = events.activation_by_window(events.read_hook_events(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 1, 2]


def test_greedy_prefers_new_terms(spark):
    rows = [(1, "t", 1200.0, "task-anchor", 200, ["a", "b"], True, False)] + [(1, f"c{i}", 640.0, "caller", 150, [f"w{j}" for j in range(20)], False, False) for i in range(4)]
    df = spark.createDataFrame(rows, "task_id long, id string, score double, role string, bytes int, terms array<string>, required boolean, known boolean")
    state = [r.state for r in pack.greedy(df, 3000).collect()]
    assert state.count("included") <= 2 and state.count("pruned") >= 3


def test_closure_is_a_fixed_point(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", None)], "source string, target string")
    start = spark.createDataFrame([("c",)], "id string")
    assert {r.id for r in graph.closure(e, start).collect()} == {"a", "b", "c", "d"}


def test_unchanged_inventory_changes_nothing(spark):
    f = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 2, 1)], "path string, hash string, size long, mtime_ns long")
    assert {r.action for r in incremental.plan(f, f).collect()} == {"reused"} and not incremental.stale(f, f).first().stale


def test_find_all_is_contains(spark):
    ids = ["B::ring_bolt.1", "B::ring_bolt.12", "B::Ring.ring.ring", "b::ÉTÉ_ring", "x", "", "B::ring_bolt.1", None]
    symbols = spark.createDataFrame([(i, "n") for i in ids], "id string, name string")
    for queries in (["ring_bolt.1", "RING", "ring", "r", "été", "nowhere", "B::ring_bolt.12", None], ["ring_bolt.12", "ring_bolt.1"], ["", "x"], []):
        found = lookup.find_all(spark.createDataFrame([(q,) for q in queries], "query string"), symbols)
        want = [(q, i) for q in queries for i in ids if q is not None and i is not None and q.lower() in i.lower()]
        assert sorted((r.query, r.id) for r in found.collect()) == sorted(want)


def test_prepare_target_has_one_rule_at_every_size(spark, tmp_path):
    n = 200_100
    brand, name = F.lit("Brand").alias("p_brand"), F.concat(F.lit("ring "), (F.col("id") % 1000).cast("string")).alias("p_name")
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), brand, name, F.lit("t").alias("p_type"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    got = {r.query: (r.id, r.ready) for r in pack_queries.prepare_target(spark, str(tmp_path)).where("query like '%.%'").collect()}
    assert len(got) == n // 20
    assert got["ring_20.100020"] == ("Brand::ring_20.100020", True) and got["ring_20.20"] == (None, False)

@pytest.fixture()
def tx(engine, tree):
    from tessera.plans.transactions import Transactions

    return Transactions(engine.store, str(tree))


def change(spark, engine, name, source):
    s = {r.name: r for r in engine.symbols().collect()}[name]
    return spark.createDataFrame([(s.id, s.hash, source)], "id string, expected_hash string, source string")


def test_transaction_rolls_back(spark, tree, engine, tx):
    old = (tree / "store/prices.py").read_text()
    with pytest.raises(snapshot.Conflict, match="no transaction"):
        tx.active()
    tx.begin()
    with pytest.raises(snapshot.Conflict, match="already active"):
        tx.begin()
    first = change(spark, engine, "postage", "def postage(amount):\n    return 7\n")
    assert "+    return 7" in tx.update(first).first().diff and (tree / "store/prices.py").read_text() == old
    tx.update(first, dry_run=False)
    tx.update(change(spark, engine, "postage", "def postage(amount):\n    return 8\n"), dry_run=False)
    assert "return 8" in (tree / "store/prices.py").read_text()
    assert [r.name for r in engine.symbols().where("source like '%return 8%'").collect()] == ["postage"]
    diff = tx.diff().collect()
    assert len(diff) == 1 and "+    return 8" in diff[0].diff and "-    return 0 if" in diff[0].diff
    with pytest.raises(snapshot.Conflict):  # an old hash
        tx.update(first, dry_run=False)
    assert tx.rollback()["status"] == "rolled_back"
    assert (tree / "store/prices.py").read_text() == old and not list((tree / "store").glob(".prices*.py.*"))
    assert engine.status()["counts"]["symbols"] > 0
    tx.begin()


def test_transaction_commits_only_tested_sources(spark, tree, engine, tx):
    tx.begin()
    tx.update(change(spark, engine, "postage", "def postage(amount):\n    return 7\n"), dry_run=False)
    with pytest.raises(snapshot.Conflict, match="tests"):
        tx.commit()
    tx.record_tests(True)
    tx.update(change(spark, engine, "total", "def total(amount, rate):\n    return postage(amount)\n"), dry_run=False)
    with pytest.raises(snapshot.Conflict, match="tests"):
        tx.commit()
    tx.record_tests(True)
    (tree / "store/broken.py").write_text("def x(:\n")
    with pytest.raises(snapshot.Conflict, match="parse"):
        tx.commit()
    (tree / "store/broken.py").unlink()
    assert tx.commit()["status"] == "committed" and "return 7" in (tree / "store/prices.py").read_text()
    with pytest.raises(snapshot.Conflict):
        tx.active()


def test_transaction_sees_changes_from_outside(spark, tree, engine, tx):
    tx.begin()
    tx.update(change(spark, engine, "postage", "def postage(amount):\n    return 7\n"), dry_run=False)
    (tree / "store/prices.py").write_text("x = 1\n")
    for end in (tx.rollback, tx.commit):
        with pytest.raises(snapshot.Conflict, match="outside"):
            end()


def test_transaction_outlives_a_crash_before_the_files(spark, tree, engine, tx, monkeypatch):
    old = (tree / "store/prices.py").read_text()
    tx.begin()

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(tx, "_put", crash)
    with pytest.raises(KeyboardInterrupt):
        tx.update(change(spark, engine, "postage", "def postage(amount):\n    return 7\n"), dry_run=False)
    monkeypatch.undo()
    assert (tree / "store/prices.py").read_text() == old and tx.log().count() == 1
    assert tx.rollback()["status"] == "rolled_back" and (tree / "store/prices.py").read_text() == old


def test_readers_keep_the_last_whole_manifest(spark, engine, monkeypatch, tmp_path):
    before = engine.status()
    folder = tmp_path / "index/manifests"
    (folder / "000000000002.json").write_text('{"version": "v-ha')
    assert engine.status() == before
    with pytest.raises(snapshot.Conflict, match="at work"):
        engine.store.swap(before["version"], {"version": "v-new"})
    monkeypatch.setattr(snapshot, "WRITING", -1.0)
    engine.store.swap(before["version"], {"version": "v-new"})
    assert engine.status()["version"] == "v-new" and (folder / "000000000003.json").exists()


# ---- operators without SQL, against direct ones

def greedy_by_hand(rows, budget):
    left, chosen, used, out = sorted(rows), [], 0, []
    while left:
        worth = {}
        for r in left:
            over = max([len(set(r[4]) & c) / max(1, len(set(r[4]) | c)) for c in chosen], default=0.0)
            worth[r[0]] = (r[1] - 260 * over) * max(0.15, 1 - over) / max(1, r[3] + pack.ROLE_COST.get(r[2], 120))
        for r in [r for r in left if worth[r[0]] < 2 and r[2] != "task-anchor" and not r[5]]:
            out.append((r[0], "pruned"))
            left.remove(r)
        if left:
            r = max(left, key=lambda r: (2 if r[2] == "task-anchor" else int(r[5]), worth[r[0]], r[1], r[0]))
            left.remove(r)
            state = "reused" if r[6] else "included" if used + r[3] <= budget else "omitted"
            out.append((r[0], state))
            if state != "omitted":
                chosen.append(set(r[4]))
                used += 0 if state == "reused" else r[3]
    return out


def frontier_by_hand(rows, budget):
    used, chosen, have, out = rows[0][5], [], set(), []
    for role in ("declaration", "dependency", "test", "caller"):
        for r in sorted((r for r in rows if r[1] == role), key=lambda r: r[2]):
            over = max([len(set(r[4]) & c) / max(1, len(set(r[4]) | c)) for c in chosen], default=0.0)
            value = (pack.FRONTIER_BASE[role] - 260 * over) * max(0.15, 1 - over) / max(1, r[3] + pack.FRONTIER_COST[role])
            state = "pruned" if role in have and value < 2 else "included" if used + r[3] <= budget else "omitted"
            if state == "included":
                used += r[3]
                have.add(role)
                chosen.append(set(r[4]))
            out.append((r[0], role, state))
    return sorted(out)


def test_packers_against_direct_ones(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    one = lambda t, i: (f"s{i:02}", float(rng.choice([1200, 900, 720, 640])), rng.choice(["task-anchor", "test", "dependency", "parent", "caller"]), rng.choice([50, 200, 400]), rng.sample(words, rng.randint(0, 8)), rng.random() < 0.2, rng.random() < 0.2)
    tasks = {t: [one(t, i) for i in range(rng.randint(1, 15))] for t in range(60)}
    df = spark.createDataFrame([(t, *r) for t, rows in tasks.items() for r in rows], "task_id long, id string, score double, role string, bytes int, terms array<string>, required boolean, known boolean")
    got = {}
    for r in pack.greedy(df, 900).orderBy("task_id", "place").collect():
        got.setdefault(r.task_id, []).append((r.id, r.state))
    for t, rows in tasks.items():
        want = greedy_by_hand(rows, 900)
        assert sorted(got[t]) == sorted(want) and [x for x in got[t] if x[1] != "pruned"] == [x for x in want if x[1] != "pruned"]

    part = lambda i: (f"s{i:02}", rng.choice(list(pack.FRONTIER_BASE)), i, rng.choice([50, 200, 400]), rng.sample(words, rng.randint(0, 8)), 100)
    tasks = {t: [part(i) for i in range(rng.randint(1, 12))] for t in range(60)}
    df = spark.createDataFrame([(t, *r) for t, rows in tasks.items() for r in rows], "task_id long, id string, role string, ord int, bytes int, terms array<string>, used int")
    got = {}
    for r in pack.frontier(df, 900).collect():
        got.setdefault(r.task_id, []).append((r.id, r.role, r.state))
    assert {t: sorted(x) for t, x in got.items()} == {t: frontier_by_hand(rows, 900) for t, rows in tasks.items()}


def test_budgets_in_other_units(spark):
    df = spark.createDataFrame([(1, "a", 1200.0, "task-anchor", ["x"], True, False, "one two three"), (1, "b", 900.0, "test", ["y"], True, False, "w " * 50)], "task_id long, id string, score double, role string, terms array<string>, required boolean, known boolean, block string")
    rows = pack.greedy(pack.measured(df, lambda t: len(t.split())), 20).collect()
    assert {r.id: r.state for r in rows} == {"a": "included", "b": "omitted"}


def test_budgets_of_the_whole_text(spark):
    """Units that merge across the seam of two blocks: the sum of the blocks' own counts says otherwise."""
    def count(t):
        return len(t.replace("\n\n", "\n").replace("xy", "z"))

    rows = [(1, "a", 1200.0, "task-anchor", ["p"], True, False, "\naaaax"), (1, "b", 900.0, "test", ["q"], True, False, "ybbb\n"), (1, "c", 800.0, "test", ["r"], True, False, "\ncc"), (1, "d", 700.0, "test", ["s"], True, True, "known" * 9)]
    df = spark.createDataFrame([(*r, len(r[-1])) for r in rows], "task_id long, id string, score double, role string, terms array<string>, required boolean, known boolean, block string, bytes int")
    whole = count("\naaaaxybbb\n\ncc")
    assert whole == sum(count(r[-1]) for r in rows[:3]) - 2
    state = lambda budget: {r.id: r.state for r in pack.greedy(df, budget, count).collect()}
    assert state(whole) == {"a": "included", "b": "included", "c": "included", "d": "reused"}
    assert list(state(whole - 1).values()).count("omitted") == 1
    packed = {r.id: r.state for r in pack.greedy(pack.measured(df, count), whole).collect()}
    assert list(packed.values()).count("omitted") == 1


def test_bootstrap_against_a_direct_one(spark):
    import math
    import random
    import statistics

    pairs = [(i, 100.0 + i, 60.0 + i % 7) for i in range(20)]
    r = stats.bootstrap_log_ratio(spark.createDataFrame([("s", *p) for p in pairs[::-1]], "stratum string, pair long, baseline double, treatment double"), 400).first()
    logs, rng = [math.log(t / b) for _, b, t in pairs], random.Random(20260912 + 20)
    draws = sorted(100 * (math.exp(statistics.mean([logs[rng.randrange(20)] for _ in logs])) - 1) for _ in range(400))
    want = (100 * (math.exp(statistics.mean(logs)) - 1), draws[10], draws[390], statistics.median(100 * (t / b - 1) for _, b, t in pairs))
    assert (r.estimate_pct, r.ci95_low_pct, r.ci95_high_pct, r.median_pair_pct) == pytest.approx(want)


def test_saving_footer(spark):
    """The percentage must be that of the payload with the footer that prints it."""
    df = spark.createDataFrame([(i, 100 + 37 * i, 3000 + 11 * (i % 5)) for i in range(90)] + [(90, 10, 0)], "task_id long, payload_chars long, expected_native_units long")
    shares = 0
    for r in pack.footer(df).collect():
        if r.expected_native_units == 0:
            assert r.percent is None
            continue
        line = "" if r.percent is None else f"estimated_token_saving_percent: {r.percent:.1f}\n"
        share = 100 * (1 - (r.payload_chars + len(line)) / r.expected_native_units)
        # the share is rounded to 4 places before the percentage is to one
        assert (r.percent is None and share < 2.5) or abs(r.percent - share) <= 0.0551
        shares += r.percent is not None
    assert shares > 60
