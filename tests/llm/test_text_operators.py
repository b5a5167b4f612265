import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, katz, license_scan, token_count, toxicity

from . import data

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_match_the_library(spark, library):
    docs = data.awkward(data.documents(spark), spark)
    out = token_count.count_tokens(docs, JSON, chunk=64, spread=500)
    want = sorted((r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()) == want


def test_token_counts_of_random_texts(library):
    machine, rng = token_count.transducer(JSON), random.Random(5)
    alphabet = "aabcde  \n\t'' stmdrvl''ll 're 've1239²½!?.,-_|é ñß漢字😀 　\x85\x1c"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert machine.tokens(text) == machine.tokens(text, 7) == library(text), text


def test_texts_without_blanks_settle(library):
    m, rng = token_count.transducer(JSON), random.Random(6)
    for alphabet in ("漢字仮名，。、「」", "abcdefgXYZ0123456789+/", "don't've!'s'll1,é²"):
        text = "".join(rng.choice(alphabet) for _ in range(6000))
        maps = [m.chunk(text[i : i + 500]) for i in range(0, len(text), 500)]
        assert all(x.settled >= 0 for x in maps)
        assert max(len(x.head) + len(x.tail) for x in maps) < 200
        assert m.finish(m.scan(maps)) == library(text)
    run = "a" * 3000
    assert m.tokens(run, 500) == library(run)


def test_a_tokenizer_that_is_not_modelled_is_refused(tmp_path):
    spec = json.load(open(JSON, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="not modelled"):
            token_count.Transducer(str(tmp_path / "t.json"))


def test_token_counts_of_an_empty_table(spark):
    assert token_count.count_tokens(data.documents(spark, []), JSON).count() == 0


def test_chunk_maps_compose_associatively():
    m, text = token_count.transducer(JSON), data.prose(random.Random(1), 60)
    maps = [m.chunk(text[i : i + 9]) for i in range(0, len(text), 9)]
    left = maps[0]
    for x in maps[1:]:
        left = m.then(left, x)
    assert m.finish(left) == m.finish(m.scan(maps)) == m.tokens(text)


def scan_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark):
    extra = ["Under the MIT License. under-the MIT/LICENSE cc by nc cc by nc", "the mit licenses", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\n", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "spdx license identifier: )", "cc by ncé", "Apache License, Version 2.0"]
    docs = data.awkward(data.documents(spark, list(enumerate(data.texts() + extra))), spark)
    out = license_scan.scan(docs)
    want = sorted(((r.doc_id, *scan_by_hand(r.text)) for r in docs.collect()), key=repr)
    assert data.rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    n = len(data.texts())
    got = {r.doc_id - n: r for r in out.where(f"doc_id >= {n}").collect()}
    assert got[2].labels == "bsd,gpl,mit" and got[2].score == 0.2
    assert got[3].labels == "gpl" and got[3].score == 0.5
    assert got[4].labels == "unknown" and got[4].score == license_scan.UNKNOWN
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values())
    assert license_scan.scan(data.documents(spark, [])).count() == 0


def test_every_tag_of_a_line_counts(spark):
    tag = "SPDX-License-Identifier:"
    texts = [f"{tag} MIT here. Later {tag} AGPL-3.0-only", f"{tag} MIT OR {tag} (ISC)", f"a {tag} MIT b " * 3000 + f"{tag} GPL-2.0-only", f"{tag} {tag} MIT", f"{tag} MIT, spdx license identifiers: GPL-2.0, xspdx license identifier GPL-2.0", f"{tag} MIT\r{tag} 0BSD\n"]
    got = data.rows(license_scan.scan(data.documents(spark, list(enumerate(texts)))), "doc_id", "labels", "score")
    assert got == [(0, "agpl,mit", 0.8), (1, "isc,mit", 0.2), (2, "gpl,mit", 0.7), (3, "mit,unknown", 0.6), (4, "mit", 0.2), (5, "bsd,mit", 0.2)]


def test_positions_of_many_phrases_take_linear_time():
    text = "cc by nc under the MIT license, " * 60_000
    began = time.perf_counter()
    assert license_scan.scan_text(text)[:4] == (420_000, 120_000, 0, 419_996)
    assert time.perf_counter() - began < 5  # counting from the text's start at each hit takes minutes


def test_license_precedence():
    assert license_scan.parse("MIT OR GPL-3.0 AND AGPL-3.0")[0] == 0.2
    assert license_scan.parse("(MIT OR GPL-3.0) AND AGPL-3.0")[0] == 0.8
    assert license_scan.parse("MIT and some text")[1] == {"mit"}
    assert license_scan.parse("MIT AND Zlib and more")[1] == {"mit", "zlib"} and license_scan.parse("mit or isc.")[1] == {"mit", "isc"}
    assert license_scan.parse("OR MIT") is None and license_scan.parse("") is None
    assert license_scan.parse("MIT OR")[1] == {"mit"}


def test_bpe_round_trip(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = data.awkward(data.documents(spark), spark)
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    out = bpe.encode_table(docs, path, public_tokenizers.PATTERN, with_ids=True)
    assert data.rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    for text in data.texts():
        assert list(bpe.encode(text, enc, 5)) == enc.encode_ordinary(text or "")


def katz_by_hand(rows):
    """Direct counts, probabilities looked up one by one."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    uni, bi, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = [*split(t), None]
            uni.update(w)
            bi.update(zip([0, *w[:-1]], w))
            starts += 1
    n, v, k = sum(uni.values()), len(uni), katz.CUTOFF

    def ratio(counts):
        of = Counter(counts.values())
        return katz.discounts([of[c] for c in range(k + 2)])

    d1, d2 = ratio(uni), ratio(bi)
    cut = lambda c, d: c * (d[c] if c <= k else 1.0)
    left = 1 - sum(cut(c, d1) for c in uni.values()) / n
    scale, unseen = (1, left) if left > 1e-12 else (n / (n + 1), 1 / (n + 1))
    p1 = lambda w: cut(uni[w], d1) / n * scale if uni[w] else unseen
    after = {}
    for (h, w), c in bi.items():
        after.setdefault(h, []).append((w, c))
    times = lambda h: starts if h == 0 else uni[h]

    def p2(h, w):
        if not times(h):
            return p1(w)
        rest, s = 1 - sum(cut(c, d2) for _, c in after[h]) / times(h), 1.0
        if rest <= 1e-9:
            rest, s = 1 / (times(h) + 1), times(h) / (times(h) + 1)
        if bi[h, w]:
            return cut(bi[h, w], d2) / times(h) * s
        return rest / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    out = []
    for i, t in rows:
        w = [*split(t), None]
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, base, sum(math.log10(p2(h, x)) for h, x in zip([0, *w[:-1]], w))))
    return out, p1, p2, uni


@pytest.mark.parametrize("size", [100, 10_000_000])
def test_katz_scores(spark, size):
    docs = data.awkward(data.documents(spark), spark)
    want, p1, p2, uni = katz_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    out = katz.score(docs, block=size, bucket=5000)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = data.rows(out, *names), sorted(want, key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    for h in [0, *list(uni)[:20]]:
        if h is not None:
            assert sum(p2(h, w) for w in [*uni, "never seen"]) == pytest.approx(1)


def test_katz_model_scores_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = katz.learn(docs, block=3000, bucket=5000)
    got = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.apply(model, docs.where(held), block=700).collect()}
    want = {r.doc_id: (r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(docs, block=3000, bucket=5000).where("held_out").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_katz_of_empty_and_untrained_tables(spark):
    assert katz.score(data.documents(spark, [])).count() == 0

    r = katz.score(data.documents(spark, [(1, "a b")]), held_out=F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_toxicity_held_out(spark):
    from tessera.llm import common

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.learn(docs, labels, toxicity.training_rows())
    out = toxicity.score(docs, model).withColumn("held", common.crc_fold("doc_id", 4) == 2).collect()
    assert len(out) == docs.count() and all(0 <= r.tox_score <= 1 for r in out)
    held = [(r.tox_score >= toxicity.THRESHOLD, truth[r.doc_id]) for r in out if r.held and r.doc_id in truth]
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.98
    few = toxicity.score(data.awkward(data.documents(spark), spark), model, keep=("lang", "score"))
    assert few.count() == data.awkward(data.documents(spark), spark).count() and few.columns == ["doc_id", "lang", "score", "tox_score"]


def test_toxicity_without_labels(spark):
    docs = data.documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.tox_score for r in toxicity.score(docs, toxicity.learn(docs, labels, toxicity.training_rows())).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.tox_score for r in toxicity.score(docs, toxicity.learn(docs, one, toxicity.training_rows())).collect()} <= {0.0, 1.0}
    assert toxicity.score(data.documents(spark, []), toxicity.learn(docs, one, toxicity.training_rows())).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=300), (rng.random(300) < 0.3).astype(float)
    knots, levels = toxicity.isotonic(z, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all() and 0 < levels[0] and levels[-1] < 1


def test_boosting_against_direct_sums():
    """Every split tried and every leaf valued by plain loops over rows."""
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0.5) | (rng.random(300) < 0.1)).astype(float)
    forest = toxicity.boost(x, y, trees=4, depth=2, rate=0.3, bins=8)
    z = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    edges = [sorted({float(e) for e in np.quantile(x[:, f], [i / 8 for i in range(1, 8)])}) for f in range(4)]

    def split(rows, depth):
        g = {i: y[i] - 1 / (1 + math.exp(-z[i])) for i in rows}
        h = {i: (1 - 1 / (1 + math.exp(-z[i]))) / (1 + math.exp(-z[i])) for i in rows}
        part = lambda own: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + 1)
        if not depth:
            return [(rows, 0.3 * sum(g.values()) / (sum(h.values()) + 1))]
        best, cut = 1e-9, None
        for f in range(4):
            for e in edges[f]:
                left, right = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                gain = part(left) + part(right) - part(rows)
                if gain > best + 1e-12:
                    best, cut = gain, (left, right)
        left, right = cut or (rows, [])
        return split(left, depth - 1) + split(right, depth - 1)

    for _ in range(4):
        for rows, value in split(list(range(len(y))), 2):
            for i in rows:
                z[i] += value
    assert forest.raw(x) == pytest.approx(z, rel=1e-9)


def test_calibration_against_the_min_max_formula():
    rng = np.random.default_rng(5)
    z = np.round(rng.standard_normal(120), 1)
    y = (rng.random(120) < 1 / (1 + np.exp(-2 * z))).astype(float)
    knots, levels = toxicity.isotonic(z, y)
    at = sorted(set(z))
    total, n = [sum(y[z == v]) for v in at], [int((z == v).sum()) for v in at]
    mean = lambda i, k: sum(total[i : k + 1]) / sum(n[i : k + 1])
    fit = [max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
    want, highest = [], 0.0
    for i in range(len(at)):
        own = [j for j in range(len(at)) if fit[j] == pytest.approx(fit[i], abs=1e-12)]
        highest = max(highest, (sum(total[j] for j in own) + y.mean()) / (sum(n[j] for j in own) + 1))
        want.append(highest)
    assert [levels[np.searchsorted(knots, v, side="right") - 1] for v in at] == pytest.approx(want, abs=1e-9)
    assert list(levels) == sorted(levels) and 0 < levels[0] and levels[-1] < 1
