"""The jobs over small tables that grow, against direct computations."""

import json
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_documents, pack_evidence
from tessera.operators import search, shared, stored

ROOT = Path(__file__).resolve().parents[1]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, rows, path, mode="append"):
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], DOCUMENTS).coalesce(1).write.mode(mode).parquet(str(path))


def terms(text):
    text = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text or "").replace("_", " ")
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text) if len(w) > 1]


def expected(live):
    out = {}
    for i, text in live.items():
        identity, body = terms(f"web/en web/en web/en {i}"), terms(text)
        for t in set(identity + body):
            out[str(i), t] = (len(identity) + len(body), identity.count(t), body.count(t))
    return out


def found(spark, index):
    rows = index_documents.postings(spark, index).collect()
    assert len(rows) == len({(r.id, r.term) for r in rows})
    return {(r.id, r.term): (r.dl, r.tf_identity, r.tf_body) for r in rows}


@pytest.fixture()
def at(tmp_path):
    return {"documents": str(tmp_path / "documents"), "index": str(tmp_path / "index"), "checkpoint": str(tmp_path / "checkpoint")}


def test_index_takes_what_is_new(spark, at):
    put(spark, [(1, "blue whales sing"), (2, "red whales"), (3, ""), (None, "no id"), (12, "oneTwo_three")], at["documents"])
    first = index_documents.run(spark, **at)
    live = {1: "blue whales sing", 2: "red whales", 3: "", 12: "oneTwo_three"}
    assert (first["batches"], first["rows"], first["without_id"], first["documents"]) == (1, 5, 1, 4)
    assert found(spark, at["index"]) == expected(live)

    again = index_documents.run(spark, **at)
    assert set(again.values()) == {0} and found(spark, at["index"]) == expected(live)

    put(spark, [(2, "green whales sing sing"), (4, "new words"), (4, "new words"), (5, "two texts"), (5, "other text"), (1, None)], at["documents"])
    third = index_documents.run(spark, **at)
    assert (third["batches"], third["rows"], third["documents"]) == (1, 6, 4)
    got = found(spark, at["index"])
    winner = {"two texts": ("5", "two") in got, "other text": ("5", "other") in got}
    assert sum(winner.values()) == 1
    assert got == expected(live | {1: None, 2: "green whales sing sing", 4: "new words", 5: max(winner, key=winner.get)})


def test_index_of_many_batches_and_a_repeated_one(spark, at, tmp_path):
    rows = [(i, f"word{i % 7} word{i % 3} common") for i in range(40)]
    for k in range(4):
        put(spark, rows[k * 10 : k * 10 + 10], at["documents"])
    assert index_documents.run(spark, **at, config={"files_per_batch": 1, "buckets": 4})["batches"] == 4
    assert found(spark, at["index"]) == expected(dict(rows))
    # a run that died after a batch's files and before its commit: the batch comes again with the same number
    for name in (f"{at['checkpoint']}/commits/3", f"{at['checkpoint']}/commits/.3.crc"):
        Path(name).unlink(missing_ok=True)
    assert index_documents.run(spark, **at, config={"files_per_batch": 1, "buckets": 4})["batches"] == 1
    assert found(spark, at["index"]) == expected(dict(rows))


def test_index_of_nothing(spark, at):
    put(spark, [], at["documents"])
    index_documents.run(spark, **at)
    put(spark, [(1, "a word")], at["documents"])
    assert index_documents.run(spark, **at)["documents"] == 1
    assert found(spark, at["index"]) == expected({1: "a word"})


def test_retrieval_over_the_kept_index(spark, at):
    put(spark, [(i, f"whale{i} sings of krill" if i % 2 else f"a ship {i}") for i in range(30)], at["documents"])
    index_documents.run(spark, **at)
    put(spark, [(1, "a quiet ship"), (31, "krill krill krill")], at["documents"])
    index_documents.run(spark, **at)
    tasks = spark.createDataFrame([(1, "where is krill"), (2, "ship")], "task_id long, text string")
    rows = stored.table(spark, at["index"])
    got = search.bm25(tasks, None, 5, stored.index(tasks, rows)).collect()
    docs = spark.read.parquet(at["documents"]).where("not (doc_id = 1 and text like 'whale%')")
    symbols = docs.select(F.col("doc_id").cast("string").alias("id"), *(F.lit("web/en").alias(c) for c in ("name", "qualname", "path")), F.lit(False).alias("is_test"), F.col("text").alias("source"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.bm25(tasks, search.documents(symbols), 5).collect()))
    assert [r.id for r in got if r.task_id == 1][0] == "31"
    plan = stored.table(spark, at["index"]).where(F.col("bucket").isin([3])).join(tasks, F.col("term") == F.col("text"), "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def packs_by_hand(tasks, docs, budget, limit):
    import math

    index = {i: (terms(f"web/en web/en web/en {i}"), terms(t)) for i, t in docs.items()}
    mean = sum(len(a) + len(b) for a, b in index.values()) / len(index)
    out = []
    for task, text in tasks.items():
        scores = {}
        for term in set(terms(text)):
            hold = [i for i, (a, b) in index.items() if term in a or term in b]
            idf = math.log1p((len(index) - len(hold) + 0.5) / (len(hold) + 0.5)) if hold else 0
            for i in hold:
                a, b = index[i]
                tf = 8 * a.count(term) + b.count(term)
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(a) + len(b)) / mean))
        used = 0
        for rank, (i, score) in enumerate(sorted(((i, round(s, 3)) for i, s in scores.items()), key=lambda x: (-x[1], str(x[0])))[:limit], 1):
            size = len(docs[i].encode())
            fits = used + size <= budget
            used += size * fits
            out.append((task, str(i), pytest.approx(score, abs=0.0011), rank, size, fits, docs[i] if fits else None))
    return sorted(out, key=lambda r: (r[0], r[3]))


def test_packs_match_a_direct_computation(spark, tmp_path):
    docs = {i: " ".join(f"w{(i * k) % 11}x" for k in range(1, 4 + i % 9)) + " é" * (i % 3) for i in range(25)}
    tasks = {1: "fix w1x and w2x", 2: "which tests cover w3x", 3: "nothing here", 4: "w5x w5x callers affected", 5: ""}
    put(spark, list(docs.items()), tmp_path / "documents")
    put(spark, [(3, docs[3]), (None, "w1x w1x w1x")], tmp_path / "documents")
    spark.createDataFrame([*tasks.items(), (None, "w1x")], "item_id long, text string").write.parquet(str(tmp_path / "tasks"))
    at = [str(tmp_path / x) for x in ("tasks", "documents", "packs")]
    config = {"budget": 90, "limit": 6}
    done = pack_evidence.run(spark, *at, config)
    rows = pack_evidence.read(spark, at[2])
    got = sorted(map(tuple, rows.drop("intent").collect()), key=lambda r: (r[0], r[3]))
    assert got == packs_by_hand(tasks, docs, 90, 6) and done["rows"] == len(got) and any(not r[5] for r in got)
    assert {(r.task_id, r.intent) for r in rows.collect()} == {(1, "understand"), (2, "test"), (4, "impact")}
    assert pack_evidence.run(spark, *at, config) == done
    assert sorted(map(tuple, pack_evidence.read(spark, at[2]).drop("intent").collect()), key=lambda r: (r[0], r[3])) == got


def test_packs_of_empty_tables(spark, tmp_path):
    put(spark, [], tmp_path / "documents")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "tasks"))
    done = pack_evidence.run(spark, *(str(tmp_path / x) for x in ("tasks", "documents", "packs")))
    assert set(done.values()) == {0} and pack_evidence.read(spark, str(tmp_path / "packs")).count() == 0


def test_jobs_leave_settings_and_no_scratch_tables(spark, at, tmp_path, monkeypatch):
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    put(spark, [(1, "a word"), (1, "a word")], at["documents"])
    spark.createDataFrame([(1, "a word")], "item_id long, text string").write.parquet(str(tmp_path / "tasks"))
    before = spark.conf.getAll
    index_documents.run(spark, **at)
    pack_evidence.run(spark, str(tmp_path / "tasks"), at["documents"], str(tmp_path / "packs"))
    assert spark.conf.getAll == before and not list((tmp_path / "shared").iterdir()) and not spark.streams.active


def test_command_lines(spark, at, tmp_path):
    put(spark, [(1, "a word"), (2, "another word")], at["documents"])
    spark.createDataFrame([(1, "another")], "item_id long, text string").write.parquet(str(tmp_path / "tasks"))
    config = tmp_path / "c.json"
    config.write_text(json.dumps(json.loads((ROOT / "jobs/index_documents.json").read_text()) | {"buckets": 4}))
    calls = [
        ["jobs.index_documents", "--documents", at["documents"], "--index", at["index"], "--checkpoint", at["checkpoint"], "--config", str(config)],
        ["jobs.pack_evidence", "--tasks", str(tmp_path / "tasks"), "--documents", at["documents"], "--output", str(tmp_path / "packs"), "--config", str(ROOT / "jobs/pack_evidence.json")],
    ]
    for call in calls:
        done = subprocess.run([sys.executable, "-m", *call], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert found(spark, at["index"]) == expected({1: "a word", 2: "another word"})
    assert [r.id for r in pack_evidence.read(spark, str(tmp_path / "packs")).collect()] == ["2"]
    assert max(int(p.name.split("=")[1]) for p in Path(at["index"]).glob("segment=*/bucket=*")) < 4
