import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, embedding_dedup, exact_dedup, mixing, ngram_join, sharding

from . import data


def components(nodes, links):
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    df = spark.createDataFrame([(a, b) for a, b in links if a != b], "a long, b long")
    nodes = {x for r in df.collect() for x in r}
    assert dict(data.rows(common.connected(df), "node", "component")) == components(nodes, [tuple(r) for r in df.collect()])
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def equal_by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    return [(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_exact_dedup(spark, limit):
    docs = data.awkward(data.documents(spark), spark)
    want = sorted(equal_by_hand([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    out = exact_dedup.exact_dedup(docs, prefix=3, broadcast_rows=limit)
    assert data.rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    gone = {r.id for r in exact_dedup.dropped(exact_dedup.decide(docs)).collect()}
    assert gone == {w[0] for w in want if not w[3]}
    assert exact_dedup.exact_dedup(data.documents(spark, [])).count() == 0


def test_exact_dedup_null_ids(spark):
    out = exact_dedup.exact_dedup(data.documents(spark, [(None, "a"), (7, "a"), (8, "b"), (None, "c")]))
    assert data.rows(out, "doc_id", "keep_id", "group_size", "kept")[:2] == [(7, 7, 2, True), (8, 8, 1, True)]
    assert out.count() == 4


def poisson(u, rate):
    k, term = 0, math.exp(-rate)
    cdf = term
    while cdf <= u:
        k += 1
        term *= rate / k
        cdf += term
    return k


def test_mixing_counts_and_shares(spark):
    rng = random.Random(4)
    docs = data.documents(spark, [(i, data.prose(rng, 5)) for i in range(3000)])
    rate = {r.src: r.rate for r in mixing.rates(docs, {"s0": 3, "s1": 1}).collect()}
    assert rate["s2"] == 0 and rate["s0"] > 2
    out = mixing.mix(docs, {"s0": 3, "s1": 1})
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    for r in docs.collect():
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 16**13
        assert got[r.doc_id] == poisson(u, rate[r.source or ""])
    size = dict(out.groupBy("source").agg(F.sum(F.octet_length("text"))).collect())
    assert size["s0"] / (size["s0"] + size["s1"]) == pytest.approx(0.75, abs=0.04)
    places = [r["__place"] for r in out.collect()]
    assert places == sorted(places)


def test_mixing_edges(spark):
    docs = data.awkward(data.documents(spark), spark)
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() > 0
    assert mixing.mix(data.documents(spark, [])).count() == 0
    many = mixing.mix(data.documents(spark, [(1, "a"), (2, "b" * 4999)]), {"s1": 0.5, "s2": 0.5}).groupBy("doc_id").count().collect()
    assert 2300 < {r.doc_id: r["count"] for r in many}[1] < 2700


def test_curve_visits_neighbours():
    table = sharding.curve_table()
    place = sorted(range(len(table)), key=table.__getitem__)
    assert sorted(table) == list(range(4096))
    point = lambda c: (c // 256, c // 16 % 16, c % 16)
    assert all(sum(abs(a - b) for a, b in zip(point(x), point(y))) == 1 for x, y in zip(place, place[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 8, 83])
def test_sharding(spark, n):
    import zlib

    rows = [(i, t) for i, t in enumerate(data.texts() * 2)][:n]
    docs = data.awkward(data.documents(spark, rows), spark)
    out = sharding.shard(docs).collect()
    assert sorted(r.id for r in out) == sorted(r.doc_id for r in docs.collect())
    texts = dict(rows)
    assert all(r.size == len((texts[r.id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.id] or "").encode()) for r in out)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    counts = [len(shards[s]) for s in range(8)]
    assert set(shards) <= set(range(8)) and max(counts) - min(counts) <= 1
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    by_place = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in by_place] == sorted(r.curve for r in out)


def vectors(seed=5, n=400, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = x[:80] + rng.normal(size=(80, dim)) * 0.1
    crowd = x[:1] + rng.normal(size=(90, dim)) * 0.08
    all_ = np.concatenate([x, near, crowd, x[:10], x[:5] * 3]).astype(np.float32)
    rows = [(i, [float(e) for e in v], i % 2 if i < n else (i - n) % 2) for i, v in enumerate(all_)]
    last = len(rows)
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] * dim, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(last + k, v, 0) for k, v in enumerate(odd)] + [(last + 20, rows[0][1], None), (last + 21, rows[0][1], None)]


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_dedup(spark, block):
    rows = vectors()
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v):
            good[i] = (label, np.array(v) / np.linalg.norm(v))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    degree, comp = Counter(x for ab in links for x in ab), components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("v", F.lit(1)).withColumn("m", F.lit(1))
    out = embedding_dedup.near_dups(df, leaf=40, sample=300, block=block)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    want = {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    assert embedding_dedup.near_dups(df.limit(0)).count() == 0


def test_embedding_rows_without_an_id_and_repeated_ones(spark):
    a, b, huge = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [1e200, 2e200, 3e200]
    rows = [(1, a, 0), (1, a, 0), (None, a, 0), (2, b, 0), (3, huge, 0), (4, [1e-310, 2e-310, 3e-310], 0), (5, a, None), (6, a, 1), (6, [-x for x in a], 1), (7, [1.0, 2.0], 0), (8, [1.0, 2.0001], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = data.rows(embedding_dedup.near_dups(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 0, None, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True), (6, 0, 6, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False)], key=repr)


def test_leaves_stay_small_when_the_sample_is_thin():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 16))
    x[10_000:] = x[:10_000] + rng.standard_normal((10_000, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = embedding_dedup.grow(x[rng.permutation(20_000)[:300]], len(x), 0.98, leaf=100)
    keys = embedding_dedup.route(forest, x)
    sizes = Counter(k for own in keys for k in own)
    assert np.mean([sizes[k] for own in keys for k in own]) < 500  # 20,000 rows over some 16 sample leaves would be 1,250 and more
    close = [i for i in range(10_000) if x[i] @ x[i + 10_000] >= 0.98]
    assert sum(bool(set(keys[i]) & set(keys[i + 10_000])) for i in close) >= 0.95 * len(close)


def test_embedding_recall_on_the_table(spark):
    """The whole table with copies of every third vector, moved about as far as the threshold allows, against all pairs
    by brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label")
    rng, rows = np.random.default_rng(3), [tuple(r) for r in table.collect()]
    for i, v, label in rows[::3]:
        if v:
            v = np.array(v, float)
            step = rng.standard_normal(len(v))
            rows.append((1_000_000 + i, [float(e) for e in v + step * np.linalg.norm(v) / np.linalg.norm(step) * rng.uniform(0.05, 0.2)], label))
    want = Counter()
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([np.float32(r[1]) for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, n in enumerate((x @ x.T >= 0.98).sum(1) - 1):
            want[own[i][0]] += int(n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_dups(df, leaf=60, sample=200).collect()}
    assert len(got) == len(rows) and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def jaccard_by_hand(rows):
    fold = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    sets = {i: {tuple(w[k : k + 5]) for w in [fold(t)] for k in range(max(1, len(w) - 4))} if fold(t) else set() for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    comp = components(sets, links)
    degree = Counter(x for ab in links for x in ab)
    return {i: (comp[i], degree[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize(("bucket", "block", "limit"), [(2048, 512, 200_000), (4, 3, 0), (12, 5, 200_000)])
def test_ngram_join(spark, bucket, block, limit):
    rng = random.Random(8)
    text = data.texts()
    core = data.prose(rng, 120).split()
    crowd = [" ".join(core[:k] + [data.prose(rng, 1)] + core[k:]) for k in range(0, 120, 4)]
    passage = data.prose(rng, 60)
    shared = [data.prose(rng, 40) + " " + passage for _ in range(12)]
    rows = list(enumerate(text + crowd + shared))
    docs = data.awkward(data.documents(spark, rows), spark)
    out = ngram_join.near_dup(docs, bucket=bucket, block=block, broadcast_rows=limit)
    want = jaccard_by_hand(rows)
    assert data.rows(out, "doc_id", "class_id", "n_links", "kept") == sorted(((r.doc_id, *want[r.doc_id]) for r in docs.collect()), key=repr)
    assert ngram_join.near_dup(data.documents(spark, [])).count() == 0


@pytest.mark.parametrize(("bucket", "block", "limit"), [(2048, 512, 200_000), (2, 1, 0)])
def test_ngram_join_takes_texts_of_one_id_apart(spark, bucket, block, limit):
    rng = random.Random(12)
    a, b = (data.prose(rng, 60) for _ in range(2))
    rows = [(2, a + " end"), (5, a), (5, b), (7, b), (9, b + " end"), (5, a), (None, b), (4, "alone"), (4, ""), (3, b + " two ends")]
    for rows, first in ((rows[:9], 5), (rows, 3)):
        docs = data.documents(spark, rows)
        want = {a + " end": (2, 1), a: (2, 1), b: (first, 2 if first == 5 else 3), b + " end": (first, 2 if first == 5 else 3), "alone": (4, 0), "": (4, 0), b + " two ends": (3, 3)}
        out = ngram_join.near_dup(docs, bucket=bucket, block=block, broadcast_rows=limit)
        assert data.rows(out, "doc_id", "class_id", "n_links", "kept") == sorted(((i, *((None, 0) if i is None else want[t]), i is None or i == want[t][0]) for i, t in rows), key=repr)
        gone = {(r.id, bytes(r.digest)) for r in ngram_join.dropped_rows(docs).collect()}
        assert gone == {(i, hashlib.sha256(t.encode()).digest()) for i, t in rows if i is not None and i != want[t][0]}
    both = ngram_join.near_dup(data.documents(spark, [(5, a), (5, a + " end")])).collect()
    assert [(r.class_id, r.n_links) for r in both] == [(5, 1)] * 2 and sum(r.kept for r in both) == 1


def test_prefix_shortens_with_the_target():
    assert ngram_join.prefix_length(0.8, 24, 6, 0.99) == 6
    assert ngram_join.prefix_length(0.8, 24, 6, 0.9999) == 5
    assert ngram_join.prefix_length(0.5, 2, 6, 0.999999) == 1

    def recall(lengths):
        return 1 - math.prod(1 - 0.8**n for n in lengths)

    usual = ngram_join.shortened(frozenset(), 0.8, 24, 6, 0.9999)
    assert set(usual) == {5, 6} and recall(usual) >= 0.9999 > recall((*usual[:-1], usual[-1] + 1))
    crowded = frozenset((t, n) for t in range(8) for n in (4, 5))
    own = ngram_join.shortened(crowded, 0.8, 24, 6, 0.9999)
    assert own[:8] == (6,) * 8 and 4 in own[8:] and recall(own) >= 0.9999
    everywhere = frozenset((t, n) for t in range(24) for n in (4, 5))
    assert ngram_join.shortened(everywhere, 0.8, 24, 6, 0.9999) == usual


def test_forest_meets_similar_sets():
    """Share of pairs of sets at the threshold that some tree brings together: the target but for sampling."""
    rng = np.random.default_rng(4)
    mult, mask = ngram_join._multipliers(24 * 6)
    usual, met = np.array(ngram_join.shortened(frozenset(), 0.8, 24, 6, 0.9999)), 0
    for _ in range(400):
        both, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        labels = np.stack([ngram_join.signature(np.concatenate([both, own[:20]]), mult, mask), ngram_join.signature(np.concatenate([both, own[20:]]), mult, mask)])
        met += any(len(ngram_join.neighbours(labels, t, 6, np.full(2, usual[t]), np.zeros(2, int), 0, 0, 0.0)[0]) for t in range(24))
    assert met >= 399


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = jaccard_by_hand(rows)
    assert data.rows(ngram_join.query(spark, sf), "doc_id", "class_id", "n_links", "kept") == sorted(((i, *want[i]) for i, _ in rows), key=repr)


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    a, near, nearer = [1.0] * 8, [1.0] * 7 + [1.1], [1.0] * 7 + [1.05]
    rows = [(5, a, 1), (5, near, 1), (9, nearer, 1), (11, [-1.0] * 8, 1)]
    out = embedding_dedup.near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert data.rows(out, "vec_id", "n_links", "component_id") == [(11, 0, 11), (5, 2, 5), (5, 2, 5), (9, 2, 5)]
