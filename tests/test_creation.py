"""Models for new symbols: the bounded search against a score of all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.operators import creation, graph, shared

SYMBOL = "id string, name string, path string, source string, is_test boolean"
TARGET = "task_id long, target string, text string"


def terms(s):
    return {w for w in "".join(c if c.isalnum() else " " for c in (s or "").lower()).split() if len(w) > 1}


def all_pairs(asked, symbols):
    out = []
    for task, target, text in dict.fromkeys(asked):
        for i, name, path, source, test in symbols:
            if test:
                continue
            a, b = (target or "").lower(), (name or "").lower()
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            asks = {w for w in terms(text) if len(w) >= 3}
            extra = (80 * ("memcmp" in (source or "").lower()) + 50 * b.endswith("cmp") + 25 * b.endswith("len")) if "startswith" in a or "prefix" in asks else 0
            score = round(12 * same + 20 * SequenceMatcher(None, a, b).ratio() + 2 * len(asks & terms(source)) + extra, 6)
            if score > 0:
                out.append((task, i, path, score))
    return out


def tables(spark, asked, symbols):
    return spark.createDataFrame(asked, TARGET), spark.createDataFrame(symbols, SYMBOL)


def world(seed):
    rng = random.Random(seed)
    stems = ["ring", "rink", "bolt", "zed", "copy_memory", "buffer"]
    ends = ["", "_size", "_cmp", "_len", "_sizes", "x", "_prefix_cmp", "_start"]
    words = "ring size bolt prefix memcmp buffer copy total".split()
    symbols = [(f"s{i}", rng.choice(stems) + rng.choice(ends), f"d{i % 5}/f{i % 11}.c", " ".join(rng.sample(words, rng.randint(0, 4))), i % 13 == 0) for i in range(120)]
    symbols += [("none", None, "d/n.c", None, False), ("empty", "", "d/n.c", "", False), ("far", "QQQ", "d/q.c", "ring", False)]
    asked = [(k, rng.choice(stems + ["wholly", "qqqq", "startswith_ring", "k", "éé"]) + rng.choice(["", "er", "_new"]), "add " + " ".join(rng.sample(words + ["other", "thing"], rng.randint(0, 5)))) for k in range(24)]
    return [*asked, (100, None, None), (101, "", "nothing here"), (102, "wxyv", "none of it"), asked[0]], symbols


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n, unit", [(3, "id"), (2, "path"), (500, "id")])
def test_best_models_are_those_of_all_pairs(spark, seed, n, unit):
    asked, symbols = world(seed)
    want, at = all_pairs(asked, symbols), {"id": 1, "path": 2}[unit]
    got = [tuple(r) for r in creation.best(*tables(spark, asked, symbols), n, unit).collect()]
    assert len(set(got)) == len(got) and set(got) <= set(want)
    for task in {w[0] for w in want}:
        best = {}
        for w in want:
            if w[0] == task:
                best[w[at]] = max(best.get(w[at], 0), w[3])
        low = sorted(best.values(), reverse=True)[:n][-1]
        assert {w for w in want if w[0] == task and w[3] >= low and w[3] == best[w[at]]} <= set(got), task


def test_whole_files_are_weighed(spark):
    asked, symbols = world(3)
    files = [(task, path) for task, *_ in asked[:6] for path in ("d0/f0.c", "d1/f1.c", "d/n.c", "absent")]
    got = creation.weigh(spark.createDataFrame(files, "task_id long, path string"), *tables(spark, asked, symbols)).collect()
    assert sorted(tuple(r) for r in got) == sorted(w for w in all_pairs(asked, symbols) if (w[0], w[2]) in set(files))


def test_files_beside_the_best_need_no_scores_of_all(spark):
    """The best file, and those of its stem, are the ones that scores of all pairs lead to."""
    asked, symbols = world(4)
    want = spark.createDataFrame(all_pairs(asked, symbols), "task_id long, id string, path string, score double")
    paths = lambda df: df.groupBy("task_id", "path").agg(F.max("score").alias("score"))
    leading = paths(creation.best(*tables(spark, asked, symbols), 2, "path"))
    first = lambda df: {(r.task_id, r.path) for r in shared.top(df, ["task_id"], [F.desc("score"), F.desc("path")], 1).collect()}
    assert first(leading) == first(paths(want))
    assert graph.companions(paths(want)).count() > 0


def test_letters_are_looked_at_only_for_tasks_that_nothing_resembles(spark, monkeypatch):
    seen, plain = [], creation._sharing_letters
    monkeypatch.setattr(creation, "_sharing_letters", lambda open_, *rest: seen.extend(r.t for r in open_.collect()) or plain(open_, *rest))
    symbols = [(f"s{i}", f"ring_{i}", "p", "", False) for i in range(30)]
    asked = [(1, "ring_new", "add it"), (2, "gnir", "add it")]
    df = creation.best(*tables(spark, asked, symbols), 5)
    assert seen == ["gnir"] and {r.task_id for r in df.collect()} == {1, 2}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_empty_tables(spark):
    asked, symbols = world(5)
    assert creation.best(*tables(spark, [], symbols), 3).count() == 0
    assert creation.best(*tables(spark, asked, []), 3).count() == 0
