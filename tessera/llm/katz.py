"""Language-model scoring with a Katz backoff model.

Tokens are words (runs of non-blanks, A-Z lower-cased) and one end per text.  The model is a bigram model that backs
off to unigrams and from them to one class of unseen words.  Counts up to ``CUTOFF`` are discounted by Good-Turing,
and each history's backoff weight is computed from exact sums over everything seen behind it, so probabilities of
all words after a history add up to 1.

Corpus-wide tables are far larger than a worker, so counting and scoring go by blocks of documents.  A block's
distinct n-grams are sorted by hash and cut by hash range into buckets; a bucket's rows from all blocks are summed
in one task, and each block gets the totals of its own n-grams back, in the same order.  The bucket's own totals are
the model's table of that hash range.  The first block that has an n-gram owns it and adds it to its history's sums,
which are dealt the same way.  A token seen in training is scored as soon as its counts are back; only backoff
weights are asked for, and only of the histories that a block backs off from (or may have to rescale).  A hot word is
one number per block in its bucket, and its successors are spread over all buckets by the hash of the pair.

``learn`` stores the tables of a corpus, and ``apply`` scores any texts by them; ``score`` learns from the training
fold and scores everything in one pass.

Null and empty texts are the end token alone.  A null id is held out.  Without training tokens
every token is of the unseen class and has probability 1.  Repeated rows count each and give a row each.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CUTOFF = 5  # counts above it are not discounted
BLOCK = 1_000_000  # tokens of a block: a worker holds about ten numbers for each
BUCKET = 1_500_000  # n-grams of a bucket, about
_END, _START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFA0C6A1B)
_table = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def pack(values: np.ndarray) -> bytes:
    """Numbers of any width, plane by plane, compressed; sorted keys go as differences."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def discounts(n: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """Katz's ratios for counts 1..cutoff from the counts of counts n[1..cutoff+1], with the largest cutoff for
    which all of them lie in (0, 1]; if there is none, half a count is taken off counts of 1."""
    for k in range(cutoff, 0, -1):
        if n[1] and all(n[c] for c in range(1, k + 1)):
            spare = (k + 1) * n[k + 1] / n[1]
            if spare < 1:
                d = [((c + 1) * n[c + 1] / n[c] / c - spare) / (1 - spare) for c in range(1, k + 1)]
                if all(0 < x <= 1 for x in d):
                    return np.array([1.0, *d, *[1.0] * (cutoff - k)])
    return np.array([1.0, 0.5, *[1.0] * (cutoff - 1)])


class Block:
    """A block's documents as numbers: words 0..W-1 in order of their hashes, W the end, W+1 the start.

    Tokens, histories and places of pairs are numbers of 4 bytes; what only helps to build them is let go at once.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, n: np.ndarray, train: np.ndarray):
        self.words, self.n, self.train = words, n, train
        w = len(words)
        ends = np.cumsum(n + 1, dtype=np.int64)
        size = int(ends[-1]) if len(n) else 0
        self.word = np.full(size, w, np.int32)
        inner = np.ones(size, bool)
        inner[ends - 1] = False
        self.word[inner] = tokens
        del inner
        self.history = np.empty(size, np.int32)
        self.history[1:] = self.word[:-1]
        self.history[ends - n - 1] = w + 1
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        self.hashes = np.concatenate([words, [_END, _START]]).astype(np.uint64)
        # distinct pairs, in order of their hashes
        key = pair_hash(self.hashes[self.history], self.hashes[self.word])
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        first = np.ones(size, bool)
        first[1:] = key[1:] != key[:-1]
        self.pair_keys = key[first]
        del key
        self.pair = np.empty(size, np.int32)
        self.pair[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
        lead = order[first]
        self.pair_history, self.pair_word = self.history[lead], self.word[lead]
        # distinct tokens, in order of their hashes; the start stands for the number of texts
        self.key_order = np.argsort(self.hashes, kind="stable")

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        size, learns = len(self.hashes), self.train[self.doc]
        uni = np.bincount(self.word[learns], minlength=size)
        uni[size - 1] = int(self.train.sum())
        return uni[self.key_order], np.bincount(self.pair[learns], minlength=len(self.pair_keys))

    def by_number(self, in_key_order: np.ndarray) -> np.ndarray:
        out = np.empty_like(in_key_order)
        out[self.key_order] = in_key_order
        return out


def read_block(row) -> Block:
    return Block(unpack_keys(row["a"]), unpack(row["b"], np.int32), np.array(row["n"], np.int32), np.array(row["train"], bool))


_PARTS = "block long, kind int, bucket int, a binary, b binary, c binary, d binary, n array<int>, train array<boolean>, ids array<long>"
_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
DOCS, UNI, BI, SUMS, STATS, ASK, DONE = range(7)
TABLE = 10  # added to the kind of what a stored table holds
MODEL = -1  # stands for the block in rows of stored tables


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    full = [tuple(r) + (None,) * (len(_NAMES) - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t) for i, t in enumerate(_TYPES)], _NAMES)


def _batches(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def blocks(docs: DataFrame, id_col: str, text_col: str, held_out, size: int) -> DataFrame:
    """Documents as rows of ``size`` tokens or more, numbered by partition and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, n, train, hashes, total = [], [], [], [], 0
        known: dict[bytes, int] = {}

        def flush():
            words, index = np.unique(np.concatenate(hashes), return_inverse=True)
            return _batch([(number, DOCS, 0, pack_keys(words), pack(index.astype(np.int32)), None, None, n, train, ids)])

        for b in batches:
            for i, text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(_table).split()
                if len(known) > 300_000:
                    known.clear()
                out = []
                for w in words:
                    h = known.get(w)
                    if h is None:
                        h = xxhash.xxh3_64_intdigest(w)
                        if len(w) <= common.SHORT:
                            known[w] = h
                    out.append(h)
                ids.append(i), n.append(len(out)), train.append(not held), hashes.append(np.array(out, np.uint64))
                total += len(out) + 1
                if total >= size:
                    yield flush()
                    number += 1
                    ids, n, train, hashes, total = [], [], [], [], 0
        if ids:
            yield flush()

    base = docs.select(F.col(id_col).cast("long").alias("id"), common.whole(text_col).alias("t"), F.coalesce(held_out, F.lit(True)).alias("held"))
    return base.mapInArrow(lambda b: common.trimmed(run(b)), _PARTS)


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted keys begins."""
    top = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))


def _send(block: int, kind: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple]:
    at = _cut(keys, buckets)
    for k, (i, j) in enumerate(zip(at, at[1:])):
        if j > i:
            yield block, kind, k, pack_keys(keys[i:j]), *(pack(v[i:j]) for v in values)


def _each(table: DataFrame, work) -> DataFrame:
    return table.mapInArrow(lambda b: common.trimmed(work(b)), _PARTS)


def send_counts(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = read_block(row)
                uni, bi = block.counts()
                words, pairs, order = block.hashes, block.pair_keys, block.key_order
                del block
                yield from _batches(_send(row["block"], UNI, words[order], buckets, uni))
                yield from _batches(_send(row["block"], BI, pairs, buckets, bi))

    return _each(table, run)


def _by_bucket(sent: DataFrame, parts: int) -> DataFrame:
    """Rows with the short columns of a message; stored tables come first in their bucket."""
    return sent.select("kind", "bucket", "block", "a", "b", "c").repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "block")


def sum_counts(sent: DataFrame, parts: int, cutoff: int) -> DataFrame:
    """Totals for each block in its own order, the first block of a key marked by the lowest bit; counts of counts; and
    the bucket's own table of n-grams seen in training."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), cols in common.runs(batches, 2):
            yield from _batches(work(kind, bucket, cols))

    def work(kind, bucket, cols) -> Iterator[tuple]:
        keys = [unpack_keys(x.as_py()) for x in cols[3]]
        uniq, first, index = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(index, np.concatenate([unpack(x.as_py(), np.int64) for x in cols[4]])).astype(np.int64)
        index = index.astype(np.int32)
        owner = np.zeros(len(index), bool)
        owner[first] = True
        live = total > 0
        yield MODEL, TABLE + kind, bucket, pack_keys(uniq[live]), pack(total[live])
        seen = total[live & (uniq != _START)] if kind == UNI else total[live]  # the start is a history, not a token
        stats = np.concatenate([[seen.sum(), len(seen)], np.bincount(seen[seen <= cutoff + 1], minlength=cutoff + 2)])
        yield MODEL, STATS, kind, None, None, None, None, None, None, stats.astype(np.int64).tolist()
        i = 0
        for block, k in zip(cols[2].to_pylist(), keys, strict=True):
            if block != MODEL:
                yield block, kind, bucket, None, pack(total[index[i : i + len(k)]] * 2 + owner[i : i + len(k)])
            i += len(k)

    return _each(_by_bucket(sent, parts), run)


class Level(NamedTuple):
    """Good-Turing statistics of one order."""

    tokens: int
    types: int
    counts: list[int]  # how many n-grams occur so often, from 0
    discount: np.ndarray  # by count, 0 to CUTOFF; 1 beyond


def levels(replies: DataFrame, cutoff: int) -> tuple[Level, Level]:
    """Statistics of both orders: the buckets' rows are summed by Spark, a dozen numbers come back."""
    rows = replies.where(F.col("kind") == STATS).select("bucket", F.posexplode("ids").alias("i", "v")).groupBy("bucket", "i").agg(F.sum("v").alias("v")).collect()
    out = []
    for kind in (UNI, BI):
        s = {r.i: int(r.v) for r in rows if r.bucket == kind}
        n = [s.get(i + 2, 0) for i in range(cutoff + 2)]
        out.append(Level(s.get(0, 0), s.get(1, 0), n, discounts(n, cutoff)))
    return out[0], out[1]


class Counted(NamedTuple):
    block: Block
    uni: np.ndarray  # totals by number
    bi: np.ndarray  # totals by pair
    owned: np.ndarray


def _by_block(*tables: DataFrame, parts: int) -> DataFrame:
    out = reduce(DataFrame.unionByName, tables)
    return out.select("block", "kind", "bucket", "a", "b", "c", "d", "n", "train", "ids").repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Counted]]:
    for (number,), cols in common.runs(batches, 1):
        kinds = np.array(cols[1].to_pylist())
        got = lambda c, kind: [cols[c][int(i)].as_py() for i in np.flatnonzero(kinds == kind)]
        d = int(np.flatnonzero(kinds == DOCS)[0])
        uni = np.concatenate([unpack(x, np.int64) for x in got(4, UNI)]) >> 1
        bi = np.concatenate([unpack(x, np.int64) for x in got(4, BI)])
        row = {"a": cols[3][d].as_py(), "b": cols[4][d].as_py(), "n": cols[7][d].as_py(), "train": cols[8][d].as_py()}
        ids = cols[9][d].as_py()
        del cols
        block = read_block(row)
        yield number, ids, Counted(block, block.by_number(uni), bi >> 1, (bi & 1).astype(bool))


def _kept(count: np.ndarray, level: Level) -> np.ndarray:
    """Discounted counts."""
    return count * np.where(count < len(level.discount), level.discount[np.minimum(count, len(level.discount) - 1)], 1.0)


def _mass(level: Level) -> float:
    """What the discounts leave for unseen words."""
    left = sum(c * n * (1 - level.discount[c]) for c, n in enumerate(level.counts[: len(level.discount)]) if c)
    return left / level.tokens if level.tokens else 1.0


class Unigrams:
    """Base of the recursion: seen words by their discounted counts, all unseen words as one class."""

    def __init__(self, level: Level):
        self.level, left = level, _mass(level)
        # with nothing left over, one more token is set aside for the class
        self.scale = 1.0 if left > 1e-12 or not level.tokens else level.tokens / (level.tokens + 1)
        self.unseen = left if left > 1e-12 else 1.0 / (level.tokens + 1)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        if not self.level.tokens:
            return np.ones(len(count))
        return np.where(count > 0, _kept(count, self.level) / self.level.tokens * self.scale, self.unseen)


_LEAST = 1e-9  # a history whose discounts leave less gives up one count in (count + 1)


def known_part(c: Counted, low: Unigrams, high: Level) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """What is known of each token before the sums of histories are: its log10 probability without the history's
    factor; for the tokens that need one, grouped, (text, history, backs off, tokens); how often numbers are histories.

    A pair seen in training needs no factor once the block's own pairs show that the discounts leave something.
    """
    b = c.block
    times = c.uni.astype(float)
    times[len(b.hashes) - 2] = 0  # nothing follows the end
    seen = c.bi > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.bincount(b.pair_history[seen], c.bi[seen] - _kept(c.bi[seen], high), len(b.hashes)) / times
        part = np.log10(np.where(seen, _kept(c.bi, high) / times[b.pair_history], low(c.uni[b.pair_word])))
    sure = left > 2 * _LEAST
    needs = np.where(seen, ~sure[b.pair_history], times[b.pair_history] > 0)[b.pair]
    code = (b.doc[needs].astype(np.int64) * len(b.hashes) + b.history[needs]) * 2 + ~seen[b.pair[needs]]
    code, n = np.unique(code, return_counts=True)
    return part, (code // 2 // len(b.hashes), code // 2 % len(b.hashes), code % 2 == 1, n), times


def history_factors(times: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 of the backoff weight and of the scale of seen successors, from a history's exact sums."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1 - kept / times
        enough = left > _LEAST
        weight = np.where(enough, left, 1 / (times + 1)) / np.maximum(1 - seen, 1e-300)
        return np.log10(weight), np.log10(np.where(enough, 1.0, times / (times + 1)))


def first_scores(met: DataFrame, low: Unigrams, high: Level, buckets: int, learns: bool) -> DataFrame:
    """For each block one row of what is known of its texts' scores, the histories it asks for, and (when the model is
    learned here) its part of the sums: discounted counts of what follows a history, and lower-order probability of it."""
    n_all, types = low.level.tokens, low.level.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, c in _met(batches):
            yield from _batches(work(number, ids, c))

    def work(number: int, ids: list, c: Counted) -> Iterator[tuple]:
        b = c.block
        size, order = len(b.n), b.key_order
        if learns:
            mine = c.owned & (c.bi > 0)
            h = b.pair_history[mine]
            kept = np.bincount(h, _kept(c.bi[mine], high), len(b.hashes))[order]
            some = np.flatnonzero(kept)
            seen = np.bincount(h, low(c.uni[b.pair_word[mine]]), len(b.hashes))[order]
            yield from _send(number, SUMS, b.hashes[order][some], buckets, kept[some], seen[some])
        part, (doc, history, backs, n), times = known_part(c, low, high)
        base = np.log10((c.uni + 0.1) / (n_all + 0.1 * (types + 1)))
        known = np.bincount(b.doc, c.uni[b.word] > 0, size)
        columns = np.concatenate([known, np.bincount(b.doc, base[b.word], size), np.bincount(b.doc, part[b.pair], size)])
        wanted, place = np.unique(b.hashes[history], return_inverse=True)
        often = np.zeros(len(wanted))
        often[place] = times[history]
        yield from _send(number, ASK, wanted, buckets)
        yield number, DONE, 0, pack(columns), pack(often), pack(np.concatenate([doc, place, backs, n]).astype(np.int32)), None, b.n.tolist(), b.train.tolist(), ids

    return _each(met, run)


def sum_sums(sent: DataFrame, parts: int) -> DataFrame:
    """Exact sums of each history: the bucket's table, and answers to the blocks that ask, in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bucket), cols in common.runs(batches, 2):
            yield from _batches(work(bucket, cols))

    def work(bucket, cols) -> Iterator[tuple]:
        keys = [unpack_keys(x.as_py()) for x in cols[3]]
        asks = [not x.is_valid for x in cols[4]]
        adds = [x for x, asked in enumerate(asks) if not asked]
        uniq, index = np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys[x] for x in adds)]), return_inverse=True)
        total = [np.bincount(index, np.concatenate([np.zeros(0), *(unpack(cols[c][x].as_py(), np.float64) for x in adds)]), len(uniq)) for c in (4, 5)]
        yield MODEL, TABLE + SUMS, bucket, pack_keys(uniq), pack(total[0]), pack(total[1])
        total = [np.append(t, 0.0) for t in total]  # the last place stands for words that nothing follows
        for x, block in enumerate(cols[2].to_pylist()):
            if asks[x]:
                at = np.searchsorted(uniq, keys[x])
                hit = at < len(uniq)
                hit[hit] = uniq[at[hit]] == keys[x][hit]
                at[~hit] = len(uniq)
                yield block, ASK, bucket, None, pack(total[0][at]), pack(total[1][at])

    return _each(_by_bucket(sent.withColumn("kind", F.lit(SUMS)), parts), run)


def last_scores(met: DataFrame, tables: DataFrame | None, tokens: int, parts: int, id_col: str) -> DataFrame:
    """The rows of ``score``: what was known, and the factors of the histories asked for."""
    sent = met.where(F.col("kind").isin(SUMS, ASK))
    if tables is not None:
        sent = sent.unionByName(tables.where(F.col("kind") == TABLE + SUMS))
    answers = sum_sums(sent, parts).where(F.col("kind") == ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in common.runs(batches, 1):
            kinds = np.array(cols[1].to_pylist())
            d = int(np.flatnonzero(kinds == DONE)[0])
            kept, seen = (np.concatenate([np.zeros(0), *(unpack(cols[c][int(i)].as_py(), np.float64) for i in np.flatnonzero(kinds == ASK))]) for c in (4, 5))
            n, train = np.array(cols[7][d].as_py(), np.int64), np.array(cols[8][d].as_py(), bool)
            known, base, part = unpack(cols[3][d].as_py(), np.float64).reshape(3, -1)
            doc, place, backs, times = unpack(cols[5][d].as_py(), np.int32).reshape(4, -1)
            weight, scale = history_factors(unpack(cols[4][d].as_py(), np.float64), kept, seen)
            part = part + np.bincount(doc, times * np.where(backs == 1, weight[place], scale[place]), len(n))
            columns = [
                pa.array(cols[9][d].as_py(), pa.int64()), pa.array(~train, pa.bool_()), pa.array(n + 1, pa.int64()), pa.array(known.astype(np.int64), pa.int64()),
                pa.array(np.full(len(n), tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(part, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = _by_block(met.where(F.col("kind") == DONE), answers, parts=parts).mapInArrow(lambda b: common.trimmed(run(b)), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


class Model(NamedTuple):
    """A corpus's n-gram tables by hash range (counts of both orders, sums of histories), and their statistics."""

    tables: DataFrame
    buckets: int
    low: Unigrams
    high: Level


def _texts(docs: DataFrame, id_col: str, text_col: str, held_out, block: int, bucket: int) -> tuple[DataFrame, int]:
    common.bounded_batches(docs.sparkSession)
    held_out = common.crc_fold(id_col, 10) == 0 if held_out is None else held_out
    table = common.written(blocks(docs, id_col, text_col, held_out, block), "lm-blocks")
    tokens = table.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x + 1))).first()[0] or 0
    return table, max(common.partitions(docs.sparkSession), -(-tokens // bucket))


def _learned(docs: DataFrame, id_col: str, text_col: str, held_out, cutoff: int, block: int, bucket: int) -> tuple[DataFrame, DataFrame, Model]:
    """Blocks' first scores, count tables, and the model but for its sums."""
    table, parts = _texts(docs, id_col, text_col, held_out, block, bucket)
    replies = common.written(sum_counts(send_counts(table, parts), parts, cutoff), "lm-counts")
    one, two = levels(replies, cutoff)
    low = Unigrams(one)
    met = common.written(first_scores(_by_block(table, replies.where(F.col("block") != MODEL), parts=parts), low, two, parts, True), "lm-met")
    common.discard(table)
    return met, replies, Model(replies.where(F.col("kind").isin(TABLE + UNI, TABLE + BI)), parts, low, two)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, cutoff: int = CUTOFF, block: int = BLOCK, bucket: int = BUCKET) -> Model:
    """The model of the rows that ``held_out`` does not hold out."""
    met, _, model = _learned(docs, id_col, text_col, held_out, cutoff, block, bucket)
    sums = sum_sums(met.where(F.col("kind") == SUMS), model.buckets).where(F.col("kind") == TABLE + SUMS)
    return model._replace(tables=model.tables.unionByName(common.written(sums, "lm-sums")))


def apply(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``score``'s columns for texts that the model was not learned from; all of them count as held out."""
    parts = model.buckets
    table, _ = _texts(docs, id_col, text_col, F.lit(True), block, BUCKET)
    counts = model.tables.where(F.col("kind").isin(TABLE + UNI, TABLE + BI)).withColumn("kind", F.col("kind") - TABLE)
    replies = sum_counts(send_counts(table, parts).unionByName(counts), parts, CUTOFF).where(F.col("block") != MODEL)
    met = common.written(first_scores(_by_block(table, replies, parts=parts), model.low, model.high, parts, False), "lm-met")
    return last_scores(met, model.tables, model.low.level.tokens, parts, id_col)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, cutoff: int = CUTOFF, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``, by a model of
    the rows that are not held out."""
    met, _, model = _learned(docs, id_col, text_col, held_out, cutoff, block, bucket)
    return last_scores(met, None, model.low.level.tokens, model.buckets, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
