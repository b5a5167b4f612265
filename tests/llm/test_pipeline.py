"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from tessera.llm import mixing, toxicity

from . import data
from .test_table_operators import equal_by_hand, jaccard_by_hand, poisson

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(stages[n].columns == stages["documents"].columns for n in ("toxicity", "exact_dedup", "ngram_join", "mixing"))


def test_toxic_documents_go(spark, stages):
    docs = stages["documents"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels, toxicity.training_rows())).collect()
    assert sorted(r.doc_id for r in scored if r.tox_score < toxicity.THRESHOLD) == sorted(i for i, _ in texts(stages["toxicity"]))


def test_copies_go(stages):
    kept = [w[0] for w in equal_by_hand(texts(stages["toxicity"])) if w[3]]
    assert sorted(i for i, _ in texts(stages["exact_dedup"])) == sorted(kept)
    near = jaccard_by_hand(texts(stages["exact_dedup"]))
    assert sorted(i for i, _ in texts(stages["ngram_join"])) == sorted(i for i, (_, _, first) in near.items() if first)


def test_mixture(stages):
    rows = stages["ngram_join"].select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source or ""] += len((r.text or "").encode())
    whole, roots = sum(size.values()), sum(v**0.5 for v in size.values())
    rate = {s: round(v**0.5 / roots * whole / v, 9) for s, v in size.items()}
    want = {r.doc_id: poisson(int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 16**13, rate[r.source or ""]) for r in rows}
    assert Counter(i for i, _ in texts(stages["mixing"])) == {i: n for i, n in want.items() if n}


def test_tokens(stages):
    want = sorted(((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts(stages["mixing"])), key=repr)
    assert data.rows(stages["byte_bpe"], "doc_id", "decoded_sha256") == want


def test_only_copies_of_a_text_go(spark):
    a, b = (data.prose(random.Random(k), 60) for k in (1, 2))
    rows = [(1, a), (2, a), (2, "alone"), (None, a), (None, "alone as well"), (None, None), (4, ""), (5, b), (5, "other words"), (3, b + " end")]
    exact = pipeline.drop_exact_copies(spark, data.documents(spark, rows), SF)
    kept = [(1, a), (2, "alone"), (None, "alone as well"), (4, ""), (5, b), (5, "other words"), (3, b + " end")]
    assert sorted(texts(exact), key=repr) == sorted(kept, key=repr)
    twice = rows + [(7, "C c"), (7, "C  c"), (7, "C c"), (None, "no id"), (None, "no id"), (1, a), (5, "other words")]
    again = [(i, " ".join(t.split())) for i, t in texts(pipeline.drop_exact_copies(spark, data.documents(spark, twice), SF))]
    assert sorted(again, key=repr) == sorted(kept + [(7, "C c"), (None, "no id")], key=repr)
    near = pipeline.drop_near_copies(spark, data.documents(spark, kept), SF)
    assert sorted(texts(near), key=repr) == sorted((r for r in kept if r != (5, b)), key=repr)


def test_run_gives_the_last_stage(spark, stages):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert data.rows(pipeline.run(spark, SF), *names) == data.rows(stages["byte_bpe"], *names)


def test_a_run_deletes_its_tables_and_no_others(spark):
    from tessera.llm import common, exact_dedup

    held = exact_dedup.exact_dedup(data.documents(spark))
    before = {x[1] for x in common._written}
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and held.count() == len(data.texts())
    left = [x for x in common._written if x[1] not in before]
    assert len([x for x in left if x[2].startswith("pipeline-rows")]) == 1  # the last stage reads it


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = data.documents(spark)
    docs = docs.unionByName(docs.where("doc_id % 9 = 0"))
    given = set(texts(docs))
    for name, stage in pipeline.STAGES:
        before = dict(texts(docs))
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "exact_dedup":
            assert sorted(i for i, _ in texts(docs)) == sorted(w[0] for w in equal_by_hand(list(before.items())) if w[3])
        if name == "ngram_join":
            assert sorted(i for i, _ in texts(docs)) == sorted(i for i, (_, _, first) in jaccard_by_hand(list(before.items())).items() if first)
    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()}.items() <= {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in given}
    assert docs.count() > 0
    empty = data.documents(spark, [])
    for name, stage in pipeline.STAGES:
        stage(spark, empty, SF).write.parquet(str(tmp_path / f"empty-{name}"))
        empty = spark.read.parquet(str(tmp_path / f"empty-{name}"))
    assert empty.count() == 0
