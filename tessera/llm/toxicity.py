"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (a fixed list of insults, and words and word stems learned from the
training labels), nearness of lexicon words to second-person words, share of capitals, punctuation and obfuscation
rates.  Everything is fitted from at most ``sample`` labelled documents, the ones with the smallest hash of their
id and of equal texts one: four tenths give the learned lexicon, four the trees, two the calibration, so that none
sees what it was selected on.  Every document is then scored by its whole text in one pass.

Null and empty texts get features of 0 and the score those lead to.  Without labels, or with one class only, every
score is the share of label 1 (0 without labels).  A document labelled twice counts with its highest label.  Rows with
a null id are scored but never learned from; rows that repeat an id and a text are learned from once and each give a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000  # labelled documents that a model is fitted on, at most
LEXICON = 400  # entries of the learned lexicon, at most
STEMS = range(4, 9)  # characters of a stem; whole words count as well
MIN_DOCS = 8  # documents of label 1 in which an entry stands, at least
MIN_RATIO = 6.0  # how much more frequent it is under label 1 than under label 0
THRESHOLD = 0.3
CACHED = 200_000  # words that a task remembers, or entries that it gathers before it passes them on

# Insults and second-person words of the four languages.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb fool ugly
liar coward bastard bitch shit fuck fucking asshole crap jerk pig filth vermin retard hate
dummkopf arschloch scheisse scheiße trottel abschaum widerlich dumm wertlos
connard salaud imbécile abruti ordure merde crétin pourriture minable
idiota imbécil estúpido basura mierda cabrón asqueroso tonto inútil""".split()
SECOND_PERSON = "you your yours yourself youre u ur du dein deine dir dich ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
_WORD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_CAPITALS, _LETTERS = bytes(range(0x41, 0x5B)), bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARKS, _EXCLAIM, _DIGITS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"!?", b"0123456789"
_MASKED = re.compile(rb"[A-Za-z][*@#$%0-9][*@#$%0-9A-Za-z]*[A-Za-z]")
_SPACED = re.compile(rb"(?:\b[A-Za-z][.\-_ ]){3,}[A-Za-z]\b")
# Characters that stand for letters in obfuscated words.
_PLAIN = bytes.maketrans(b"@431$50!7", b"aaeissoit")
_NEAR = 4  # words
FEATURES = ("fixed_density", "fixed_count", "learned_density", "learned_count", "learned_kinds", "learned_weight", "near_second", "second_density", "capitals", "marks", "exclaims", "digits", "masked_rate", "masked_hits", "mean_word", "log_words")


class Lexicons(NamedTuple):
    fixed: frozenset[bytes]
    second: frozenset[bytes]
    learned: dict[bytes, float]  # with their weights


def entries(word: str) -> set[str]:
    """A word's stems, and the word itself."""
    return {word[:k] for k in STEMS if len(word) > k} | {"=" + word}


def weights(words: list[bytes], learned: dict[bytes, float], known: dict[bytes, float]) -> list[float]:
    """The weight of each word: its heaviest entry, 0 without one.  ``known`` remembers those of a task."""
    if len(known) > CACHED:
        known.clear()
    out = []
    for w in words:
        x = known.get(w)
        if x is None:
            x = max((learned.get(e.encode(), 0.0) for e in entries(w.decode("utf-8", "replace"))), default=0.0) if learned else 0.0
            if len(w) <= common.SHORT:
                known[w] = x
        out.append(x)
    return out


def features(text: str | None, lex: Lexicons, known: dict[bytes, float] | None = None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w for w in raw.translate(_WORD).split(b" ") if w]
    n, size = max(1, len(words)), max(1, len(raw))
    hit = [i for i, w in enumerate(words) if w in lex.fixed]
    weight = weights(words, lex.learned, {} if known is None else known)
    own = [w for w, x in zip(words, weight, strict=True) if x]
    you = [i for i, w in enumerate(words) if w in lex.second]
    spots = set(you)
    near = sum(any(j in spots for j in range(i - _NEAR, i + _NEAR + 1)) for i in hit)
    masked = _MASKED.findall(raw) + [re.sub(rb"[^A-Za-z]", b"", x) for x in _SPACED.findall(raw)]
    unmasked = sum(x.translate(_PLAIN).lower() in lex.fixed for x in masked)
    less = lambda drop: size - len(raw.translate(None, drop)) if raw else 0
    letters = less(_LETTERS)
    return [
        len(hit) / n, math.log1p(len(hit)), len(own) / n, math.log1p(len(own)), math.log1p(len(set(own))), sum(weight) / n, near / n, len(you) / n,
        less(_CAPITALS) / max(1, letters), less(_MARKS) / size, less(_EXCLAIM) / size, less(_DIGITS) / size,
        len(masked) / n, float(unmasked), sum(map(len, words)) / n, math.log1p(len(words)),
    ]


class Forest(NamedTuple):
    """Boosted depth-limited trees in arrays, then a step function for calibration."""

    base: float
    split_on: np.ndarray  # tree x node
    split_at: np.ndarray
    value: np.ndarray  # tree x leaf
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(math.log2(self.value.shape[1])) if self.value.size else 0
        rows = np.arange(len(x))
        for on, at, leaf in zip(self.split_on, self.split_at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, on[node]] > at[node])
            out += leaf[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x)
        return self.levels[np.clip(np.searchsorted(self.knots, z, side="right") - 1, 0, len(self.levels) - 1)]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss on quantile histograms; deterministic."""
    p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = math.log(p / (1 - p))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    z = np.full(len(y), base)
    inner = 2**depth - 1
    on, at, val = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-z))
        g, h = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-9
                for f, e in enumerate(edges):
                    if not len(e) or not len(rows):
                        continue
                    b = binned[rows, f]
                    gs = np.cumsum(np.bincount(b, g[rows], len(e) + 1))
                    hs = np.cumsum(np.bincount(b, h[rows], len(e) + 1))
                    G, H = gs[-1], hs[-1]
                    gain = gs[:-1] ** 2 / (hs[:-1] + ridge) + (G - gs[:-1]) ** 2 / (H - hs[:-1] + ridge) - G * G / (H + ridge)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, on[t, k], at[t, k] = gain[i], f, e[i]
                node[rows] = 2 * k + 1 + (x[rows, on[t, k]] > at[t, k])
        leaf = node - inner
        val[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        z += val[t][leaf]
    return Forest(base, on, at, val, np.zeros(1), np.full(1, p))


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; every block is shrunk by one pseudo-row towards the mean so that no score is certain."""
    at, place = np.unique(z, return_inverse=True)  # rows of equal z are one from the start
    blocks: list[list[float]] = []  # first z, weight, sum
    for v, n, total in zip(at, np.bincount(place, minlength=len(at)), np.bincount(place, y, len(at)), strict=True):
        blocks.append([float(v), float(n), float(total)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    mean = float(y.mean())
    levels = np.maximum.accumulate([(s + mean) / (w + 1) for _, w, s in blocks])
    return np.array([b[0] for b in blocks]), levels


def _bytes(words) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words)


def learn(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> tuple[Lexicons, Forest]:
    """Fit on the rows of ``labels`` that the condition ``training`` (a column over ``id_col``) lets through."""
    chosen = (
        labels.where(training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    chosen = common.written(chosen, "toxic-sample")
    # at most `sample` rows of two numbers: bounded whatever the input, so it may be broadcast; only texts that the join
    # lets through are hashed, and rows that repeat an id are put together before any text moves
    texts = docs.select(F.col(id_col).alias("id"), common.whole(text_col).alias("t"))
    digest = F.sha2("t", 256).alias("h")
    firsts = texts.join(F.broadcast(chosen), "id").select("id", "y", digest).groupBy("h").agg(F.min(F.struct("id", "y")).alias("f")).select("h", "f.id", "f.y")
    firsts = common.written(firsts, "toxic-firsts")
    met = texts.join(F.broadcast(firsts.select("id").distinct()), "id").select("id", "t", digest)
    rows = common.written(met.join(F.broadcast(firsts), ["id", "h"]).dropDuplicates(["h"]), "toxic-texts")
    fold = F.pmod(F.xxhash64("h", F.lit("fold")), F.lit(10))

    def passed_on(found: dict[str, list[int]]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(3))], ["w", "docs", "pos", "neg"])
        found.clear()
        return out

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tf: dict[str, int] = {}
                for w in t.encode("utf-8", "surrogatepass").translate(_WORD).split():
                    for e in entries(w.decode("utf-8", "replace")):
                        tf[e] = tf.get(e, 0) + 1
                for e, n in tf.items():
                    at = found.setdefault(e, [0, 0, 0])
                    at[0] += y
                    at[1 if y else 2] += n
                if len(found) > CACHED:
                    yield passed_on(found)
        yield passed_on(found)

    common.bounded_batches(docs.sparkSession)
    first = rows.where(fold < 4)
    sums = first.select("y", F.size(F.split("t", common.WHITE)).alias("n")).agg(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.sum(F.when(F.col("y") == 0, F.col("n")))).first()
    n_pos, n_neg = (sums[0] or 0) + 1, (sums[1] or 0) + 1
    counts = first.select("y", "t").mapInArrow(lambda b: common.trimmed(gather(b)), "w string, docs long, pos long, neg long").groupBy("w").agg(F.sum("docs").alias("docs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = (F.col("pos") + 0.5) / n_pos / ((F.col("neg") + 0.5) / n_neg)
    top = counts.withColumn("r", ratio).where((F.col("docs") >= MIN_DOCS) & (F.col("r") >= MIN_RATIO)).orderBy(F.desc(F.log("r") * F.sqrt("docs")), "w").limit(lexicon)
    lex = Lexicons(_bytes(INSULTS), _bytes(SECOND_PERSON), {r.w.encode(): math.log(r.r) for r in top.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for b in batches:
            x = [features(t, lex, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    # at most `sample` rows of len(FEATURES) numbers
    got = rows.where(fold >= 4).select("y", fold.alias("fold"), "t").mapInArrow(lambda b: common.trimmed(run(b)), "y int, fold long, x array<double>").toPandas()
    if not len(got) or got["y"].nunique() < 2:
        p = float(got["y"].mean()) if len(got) else 0.0
        empty = np.zeros((0, 7))
        return lex, Forest(0.0, empty, empty, np.zeros((0, 8)), np.zeros(1), np.full(1, p))
    x, y, part = np.array(got["x"].tolist()), got["y"].to_numpy(float), got["fold"].to_numpy()
    order = np.lexsort([*x.T, y, part])
    x, y, part = x[order], y[order], part[order]
    fit, cal = part < 8, part >= 8
    if y[fit].min() == y[fit].max() or not cal.any() or y[cal].min() == y[cal].max():
        fit = cal = np.ones(len(y), bool)
    forest = boost(x[fit], y[fit])
    knots, levels = isotonic(forest.raw(x[cal]), y[cal])
    return lex, forest._replace(knots=knots, levels=levels)


def score(docs: DataFrame, model: tuple[Lexicons, Forest], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``tox_score`` for every row; scored where the texts are read."""
    common.bounded_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructField, StructType

    lex, forest = model
    cols = [id_col, *(c for c in keep if c not in (id_col, text_col))]
    chosen = docs.select(*cols, text_col)
    out = chosen if text_col in keep or text_col == id_col else docs.select(*cols)
    width = len(out.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            x = np.array([features(t, lex, known) for t in texts]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(forest.score(x), pa.float64())], [*b.schema.names[:width], "tox_score"])

    return chosen.mapInArrow(lambda b: common.trimmed(run(b)), StructType([*out.schema.fields, StructField("tox_score", DoubleType())]))


def training_rows(id_col: str = "doc_id"):
    return common.crc_fold(id_col, 4) != 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, learn(docs, labels, training_rows()))
    return scored.select("doc_id", (~training_rows()).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
