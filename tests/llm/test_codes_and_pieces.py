import hashlib
import random
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tessera.llm import code_compression, piece_bpe

from . import data

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_match_the_library(spark, library):
    docs = data.awkward(data.documents(spark, [*enumerate(data.texts()), (None, "no id"), (None, None)]), spark)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    out = piece_bpe.encode_table(docs, MODEL, with_ids=True)
    assert data.rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert piece_bpe.encode_table(data.documents(spark, []), MODEL).count() == 0


def test_pieces_of_random_texts(library):
    m, rng = piece_bpe.model(MODEL), random.Random(4)
    pieces = [p.replace("▁", " ") for p in m.score]
    alphabets = ["ab ▁", "aeiou tsrn", "  \n\tx", "漢字仮名 éñ😀\x00ﬁ", "<s>/unk▁ 0123456789", pieces]
    for _ in range(2000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
        parts = list(m.encoded(text, 30))
        ids = [i for p in parts for i in m.unpack(p)]
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert "".join(m.decoded(parts)) == library.decode(ids), text


def test_decoding_of_ids_that_no_text_gives(library):
    m, rng = piece_bpe.model(MODEL), random.Random(5)
    for _ in range(1000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert "".join(m.decoded([m.pack(array("I", ids))])) == library.decode(ids), ids


def test_tables_of_a_worker_are_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "WORDS", 50)
    monkeypatch.setattr(piece_bpe, "PAIRS", 50)
    m, text = piece_bpe.Model(MODEL), data.prose(random.Random(1), 3000)
    assert [i for p in m.encoded(text) for i in m.unpack(p)] == library.encode(text, add_bos=True, add_eos=True)
    assert len(m.words) <= 50 and len(m.pairs) <= 50


def test_a_model_with_other_rules_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in (lambda s: setattr(s.normalizer_spec, "remove_extra_whitespaces", True), lambda s: setattr(s.trainer_spec, "model_type", 1), lambda s: setattr(s.pieces[500], "type", 4)):
        spec = proto.ModelProto()
        spec.ParseFromString(open(MODEL, "rb").read())
        change(spec)
        (tmp_path / "m.model").write_bytes(spec.SerializeToString())
        with pytest.raises(ValueError, match="not modelled"):
            piece_bpe.Model(str(tmp_path / "m.model"))


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_rounds(rows, parts=16, entries=64, rounds=2, limit=1 << 40):
    """Every part against every entry, in whole numbers of any size."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    ints = lambda v: [max(-limit, min(limit, int(np.floor(float(x) * 256)))) for x in v] + [0] * (width * parts - len(v))
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in (ints(r[1]) for r in kept)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(x[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for x in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, c in zip(cut, codes, strict=True) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    codes = assign()
    error = [sum(d for d, _ in c) for c in codes]
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in c), d, total[r[2]], digest) for r, c, d in zip(kept, codes, error, strict=True)]


COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize(("n", "dim", "block"), [(300, 32, 320), (300, 32, 1 << 18), (40, 16, 64), (120, 20, 100)])
def test_codes_match_plain_rounds(spark, n, dim, block):
    rng = np.random.default_rng(n + dim)
    spots = rng.normal(size=(12, dim))
    vectors = [(spots[i % 12] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist() for i in range(n)]
    rows = [(int(i), v, int(i) % 3 if i % 7 else None) for i, v in zip(rng.permutation(n), vectors, strict=True)]
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], 1), (None, vectors[9], 2), (n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [float("inf")] + [0.0] * (dim - 1), 1), (n + 3, [None] * dim, 1), (n + 4, [0.0] * dim, 1), (n + 5, [], None), (n + 6, [0.25] * (dim - 3), 2)]
    df = data.awkward_names(spark.createDataFrame(rows, VECTORS).repartition(3))
    out, books = code_compression.compress(df, block=block)
    assert data.rows(out, *COLUMNS) == sorted(plain_rounds(rows), key=repr)
    assert books.shape == (16, min(64, n + 7), -(-dim // 16))


def test_codes_of_few_equal_and_huge_vectors(spark):
    few = [(i, [0.5] * 16, 1) for i in range(5)]
    one = [(7, [1.0] * 16, None)]
    huge = [(i, [(-1.0) ** i * 3e38] * 8 + [i / 7] * 8, i % 2) for i in range(80)]
    for rows in (few, one, huge):
        out, _ = code_compression.compress(spark.createDataFrame(rows, VECTORS))
        assert data.rows(out, *COLUMNS) == sorted(plain_rounds(rows, limit=int(((1 << 60) // 16) ** 0.5)), key=repr)
    out, books = code_compression.compress(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert out.columns == list(COLUMNS) and out.count() == 0 and books.size == 0


def test_heaps_spare_most_parts_and_miss_none():
    """Only violated parts are measured again, and every part has its nearest entry all the same."""
    rng = np.random.default_rng(3)
    spots = rng.integers(-4000, 4000, (64, 4))
    x = (spots[rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (4000, 4)))[:, None]
    books = x[:64, 0][None].copy()
    block, sums, counts = code_compression.Block.first(x, books)
    drift = np.zeros((1, 64))
    for turn in range(4):
        totals = [sums, counts] if turn == 0 else [totals[0] + sums, totals[1] + counts]
        books, drift = code_compression._moved(books, totals[0].astype(object), totals[1].astype(object), drift)
        spared = 1 - block.popped(0, drift[0]).mean()
        sums, counts = block.advance(books, drift)
        assert (block.code[:, 0] == code_compression.distances(x[:, 0], books[0]).argmin(1)).all()
    assert spared > 0.5


def test_codes_against_sql(spark, sf):
    out = code_compression.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = con.execute(code_compression.ORACLE)
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()), key=repr)
    assert data.rows(out, *COLUMNS) == want
