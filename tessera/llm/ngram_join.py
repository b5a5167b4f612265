"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A document is the set of hashes of its five-word shingles (words: runs of non-blanks, A-Z lower-cased; a text of
fewer words is one shingle).  Each tree of the forest labels it by a sequence of min-hashes.  A tree is a trie of sorted
labels: the documents below a prefix are one run of the sorted order.  A document starts with the full label in every
tree and shortens its prefixes, one tree at a time, until a pair at the threshold is met in some tree with the target
recall; steps into crowded nodes come last, so a document with boilerplate in some trees takes shorter prefixes in the
others.  It probes the node below its prefix in each tree, and everything there is a neighbour if the whole labels
agree well enough to be similar at all.

Neighbours are connected into groups.  A small group is verified exactly as one block.  A large one is cut into blocks by
a min-hash, so that similar documents tend to share one, and only pairs of blocks that hold neighbours are verified.
Verification returns link counts per document and a star of links per block, never all pairs.

Documents with equal words are one class and are compared once; the digest of a class is its node in every step.
Null, empty and blank texts have no shingles and link with nothing, and so do rows with a null id.  Rows that repeat an
id with equal words are one document and get the same decision; with other words they are another document, with links
and a class of its own.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .embedding_dedup import local_components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 6  # trees and min-hashes of a label
RECALL = 0.9999  # of pairs at the threshold, in the forest
SLACK = 0.15  # pairs whose sketches are further below the threshold than this are not similar
BUCKET = 2048  # documents below a trie node that are compared in one task; more make the node crowded
BLOCK = 512  # documents of a group that are verified in one task, about
CACHED = 200_000  # word hashes a task remembers
SLICE = 500_000  # hashes of a group that are compared at once, about

_table = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that, used in every tree, meets a pair at the threshold with the target recall."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


@functools.lru_cache(4096)
def shortened(crowded: frozenset[tuple[int, int]], threshold: float, trees: int, depth: int, recall: float) -> tuple[int, ...]:
    """A document's prefix length in each tree; ``crowded`` holds (tree, length) of its nodes that are.

    Lengths go down one by one, first where the next node is not crowded, then where the prefix is longest, until the
    target is met.  Sizes below the crowd take no part, so that whom a document meets does not decide where it looks.
    """
    shortest = max(1, prefix_length(threshold, trees, depth, recall) - 1)
    length = [depth] * trees
    missed = lambda n: math.log1p(-(threshold**n))
    while sum(map(missed, length)) > math.log1p(-recall):
        steps = [((t, n - 1) in crowded, -n, t) for t, n in enumerate(length) if n > shortest]
        if not steps:
            break
        length[min(steps)[2]] -= 1
    return tuple(length)


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of a text's words; ``known`` remembers those of a task."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_table).split()
    if len(known) > CACHED:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= common.SHORT:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def class_digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(common.whole(text_col), 256))


def shingles(h: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words."""
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(s: np.ndarray, mult: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Two bytes of each min-hash, from where they are even however small the minimum is."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            low = np.minimum(low, ((s[i : i + 1024, None] ^ mask) * mult).min(0))
    return (low >> np.uint64(16)).astype(np.uint16)


def sketch(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """``id, digest, cls, labels``: digests of text and class, and the labels in all trees, two bytes a min-hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, mask = _multipliers(trees * depth)
        known: dict[bytes, int] = {}
        for b in batches:
            cls, labels = [], []
            for text in b.column(1).to_pylist():
                h = word_hashes(text, known)
                cls.append(class_digest(h) if len(h) else None)
                labels.append(signature(shingles(h), mult, mask).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cls, pa.binary()), pa.array(labels, pa.binary())], ["id", "digest", "cls", "labels"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col), text_digest(text_col).alias("digest"))
    return rows.mapInArrow(lambda b: common.trimmed(run(b)), "id long, digest binary, cls binary, labels binary")


def neighbours(labels: np.ndarray, tree: int, depth: int, need: np.ndarray, mine: np.ndarray, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (by row) below a trie node, or between two of its blocks: one probes a node that holds both, and their
    labels agree in the share ``least`` or more.

    Sorted labels are the trie: rows below a prefix are a run, found by comparing each label with the next.
    """
    part = labels[:, tree * depth : (tree + 1) * depth]
    order = np.lexsort(part.T[::-1])
    part = part[order]
    # how many leading min-hashes a label shares with the one before it
    shared = np.minimum.accumulate(part[1:] == part[:-1], axis=1).sum(1)
    a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(need[need <= depth]):
        cuts = np.flatnonzero(shared < length) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]])
        for k in np.flatnonzero(ends - starts > 1):
            run = order[starts[k] : ends[k]]
            probes = run[need[run] == length]
            for i in range(0, len(probes), 64):
                asked = probes[i : i + 64]
                a, b = np.nonzero((labels[asked, None, :] == labels[None, run, :]).mean(2) >= least)
                a, b = asked[a], run[b]
                keep = (a != b) if lo == hi else (mine[a] != mine[b])
                a_all.append(a[keep])
                b_all.append(b[keep])
    return np.concatenate(a_all), np.concatenate(b_all)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections between two lists of sets (by index).

    The sets are sorted hashes, so a range of hashes is a slice of each of them; ranges are taken one at a time, each of
    about SLICE hashes in all, so that memory does not grow with the texts.
    """
    out = np.zeros((len(left), len(right)), np.float64)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    ranges = max(1, -(-sum(map(len, sets)) // SLICE))
    cuts = np.array([k * 2**64 // ranges for k in range(1, ranges)], np.uint64)
    at = np.array([[0, *np.searchsorted(s, cuts), len(s)] for s in sets])
    for k in range(ranges):
        _add_overlaps(out, [s[i:j] for s, i, j in zip(sets, at[:, k], at[:, k + 1], strict=True)], place_l, place_r)
    return out


def _add_overlaps(out: np.ndarray, sets: list[np.ndarray], place_l: np.ndarray, place_r: np.ndarray) -> None:
    """Add the sizes of intersections by strips of an incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = n[col] > 1
    owner, col = owner[keep], (np.cumsum(n > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = int((n > 1).sum())
    for i in range(0, width, 4096):
        a, b = np.searchsorted(col, [i, i + 4096])
        o, c = owner[a:b], col[a:b] - i
        x, y = np.zeros((out.shape[0], min(4096, width - i)), np.float32), np.zeros((out.shape[1], min(4096, width - i)), np.float32)
        in_l, in_r = place_l[o] >= 0, place_r[o] >= 0
        x[place_l[o[in_l]], c[in_l]] = 1
        y[place_r[o[in_r]], c[in_r]] = 1
        out += x @ y.T


def verify(m: np.ndarray, sets: list[np.ndarray], mine: np.ndarray, lo: int, hi: int, threshold: float):
    """Exact links of a group (or two of its blocks): row, links to other classes' documents, first row reached."""
    left = np.flatnonzero(mine == lo)
    right = left if lo == hi else np.flatnonzero(mine == hi)
    if not len(left) or not len(right):
        return left[:0], m[:0], left[:0]
    inter = overlaps(sets, left, right)
    lens = np.array([len(s) for s in sets])
    union = lens[left][:, None] + lens[right][None, :] - inter
    a, b = np.nonzero(inter / np.maximum(union, 1) >= threshold)
    a, b = left[a], right[b]
    keep = a < b if lo == hi else a != b
    a, b = a[keep], b[keep]
    links = np.zeros(len(m), np.int64)
    np.add.at(links, a, m[b])
    np.add.at(links, b, m[a])
    low = local_components(len(m), a, b)
    at = np.unique(np.concatenate([a, b]))
    return at, links[at], low[at]


def _part(tree: Column, depth: int) -> Column:
    return F.substr(F.col("labels"), tree * (2 * depth) + 1, F.lit(2 * depth))


def _node(tree: Column, depth: int, length: Column) -> Column:
    """Key of the trie node that a document's prefix of a length leads to."""
    return F.xxhash64(tree, length, F.substr(_part(tree, depth), F.lit(1), length * 2))


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Cut the rows of a node into blocks; a row meets every block of its node once, in task (lo, hi)."""
    out = rows.withColumn("__b", blocks).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("__b")).cast("int"))
    out = out.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return out.withColumn("lo", F.least("mine", "__o")).withColumn("hi", F.greatest("mine", "__o")).drop("__b", "__o")


def probes(reps: DataFrame, threshold: float, trees: int, depth: int, recall: float, bucket: int, broadcast_rows: int) -> DataFrame:
    """``node, tree, need, cls, lo, hi, mine``: the trie nodes that hold more than one document and are probed by one.

    Nodes are met at the shortest prefix that any document takes; longer prefixes are runs within it.  Only below a
    crowded node do longer prefixes get rows of their own, so that no task holds the whole of it.
    """
    shortest = max(1, prefix_length(threshold, trees, depth, recall) - 1)
    tree, usual = F.col("tree"), shortened(frozenset(), threshold, trees, depth, recall)
    every = reps.select("cls", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    nodes = every.select("cls", "tree", _node(tree, depth, F.lit(shortest)).alias("node"))
    counted = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    near = common.written(nodes.join(counted, "node"), "ngram-near")
    usual_need = F.array(*map(F.lit, usual))[tree]
    calm = near.where(F.col("n") <= bucket)

    # documents with a crowded node choose their own lengths
    crowd = near.where(F.col("n") > bucket).select("cls", "tree").join(reps.select("cls", "labels"), "cls")
    crowd = crowd.withColumn("length", F.explode(F.sequence(F.lit(shortest), F.lit(depth))))
    crowd = common.written(crowd.select("cls", "tree", "length", _node(tree, depth, F.col("length")).alias("node")), "ngram-crowd")
    sizes = common.written(crowd.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "ngram-sizes")
    met = crowd.join(common.small(sizes, broadcast_rows), "node")
    full = met.where(F.col("n") > bucket).groupBy("cls").agg(F.collect_list(tree * 64 + F.col("length")).alias("full"))  # at most one a tree and length

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            needs = [shortened(frozenset((x // 64, x % 64) for x in full), threshold, trees, depth, recall) for full in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(needs, pa.list_(pa.int32()))], ["cls", "needs"])

    chosen = common.small(common.written(full.mapInArrow(lambda b: common.trimmed(choose(b)), "cls binary, needs array<int>"), "ngram-needs"), broadcast_rows)
    need = F.coalesce(F.col("needs")[tree], usual_need)
    calm = _dealt(calm.join(chosen, "cls", "left").select("node", "tree", need.alias("need"), "cls"), F.lit(1))
    length = F.col("length")
    met = met.join(chosen, "cls", "left").select("node", "n", "tree", F.when(length == need, length).otherwise(depth + 1).alias("need"), "cls")
    asked = met.where(F.col("need") <= depth).select("node").distinct()
    full = _dealt(met.join(asked, "node", "left_semi"), F.ceil(F.col("n") / bucket).cast("int")).drop("n")
    return common.written(calm.unionByName(full), "ngram-probes")


def _paired(rows: DataFrame, parts: int, depth: int, least: float, out, schema: str) -> DataFrame:
    """Find neighbours node by node; ``out`` turns (columns, a, b) of one task's part into record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (_, lo, hi), cols in common.runs(batches, 3):
            labels = np.frombuffer(b"".join(cols[6].to_pylist()), np.uint16).reshape(len(cols[6]), -1)
            a, b = neighbours(labels, cols[4][0].as_py(), depth, cols[5].to_numpy(), cols[3].to_numpy(), lo, hi, least)
            if len(a):
                held.append(out(cols, a, b))
                size += 1
            if size >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    order = ["node", "lo", "hi"]
    return rows.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda b: common.trimmed(run(b)), schema)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, slack: float = SLACK, bucket: int = BUCKET, block: int = BLOCK, broadcast_rows: int = common.BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """``id, digest, cls`` of every row, and ``cls, n_links, class_id, first`` of the classes that have a link.

    Of a group of linked classes, the smallest id (``class_id``) in the class ``first`` stays.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = common.written(sketch(docs, id_col, text_col, trees, depth), "ngram-sketch")
    base = rows.where("cls is not null and id is not null")
    same = common.written(base.groupBy("cls").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("m")), "ngram-class")
    reps = common.written(base.join(same, "cls").where("id = rep").dropDuplicates(["cls"]).select("cls", "rep", "m", "labels"), "ngram-rep")

    met = probes(reps, threshold, trees, depth, recall, bucket, broadcast_rows)
    near = met.join(reps.select("cls", "labels"), "cls").select("node", "lo", "hi", "mine", "tree", "need", "labels", "cls")
    parts = common.partitions(spark)

    def stars(cols, a, b) -> pa.RecordBatch:
        low = local_components(len(cols[7]), a, b)
        at = np.unique(np.concatenate([a, b]))
        at = at[at != low[at]]
        return pa.RecordBatch.from_arrays([cols[7].take(pa.array(at)), cols[7].take(pa.array(low[at]))], ["a", "b"])

    groups = common.connected(_paired(near, parts, depth, threshold - slack, stars, "a binary, b binary").distinct())
    groups = common.written(groups.select(F.col("node").alias("cls"), F.col("component").alias("grp")).join(same, "cls"), "ngram-groups")
    large = common.small(common.written(groups.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > block).select("grp"), "ngram-large"))
    one = groups.join(large, "grp", "left_anti").select("grp", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("mine"), "cls", "m")

    # large groups: blocks by the first min-hash; a value that too many share is cut by the class, rare ones are put together
    first = F.substr(F.col("labels"), F.lit(1), F.lit(2))
    spread = groups.join(large, "grp", "left_semi").join(reps.select("cls", first.alias("first")), "cls").select("grp", "first", "cls", "m")
    values = common.written(spread.groupBy("grp", "first").agg(F.count("*").alias("n")), "ngram-values")
    rare = values.where(F.col("n") <= block).groupBy("grp").agg(F.ceil(F.sum("n") / block).alias("slots"))
    spread = spread.join(common.small(values, broadcast_rows), ["grp", "first"]).join(common.small(rare, broadcast_rows), "grp", "left")
    often = F.xxhash64(F.lit(0), "grp", "first", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / block)))
    mine = F.when(F.col("n") > block, often).otherwise(F.xxhash64(F.lit(1), "grp", F.pmod(F.xxhash64("first"), F.col("slots"))))
    spread = common.written(spread.select("grp", mine.alias("mine"), "cls", "m"), "ngram-blocks")

    def block_pairs(cols, a, b) -> pa.RecordBatch:
        own = cols[9].to_numpy()
        pair, at = np.unique(np.stack([np.minimum(own[a], own[b]), np.maximum(own[a], own[b])]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([cols[8].take(pa.array(a[at])), pa.array(pair[0]), pa.array(pair[1])], ["grp", "lo", "hi"])  # neighbours are of one group

    inside = near.join(spread.select("cls", "grp", F.col("mine").alias("own")), "cls").select("node", "lo", "hi", "mine", "tree", "need", "labels", "cls", "grp", "own")
    wanted = common.written(_paired(inside, parts, depth, threshold - slack, block_pairs, "grp binary, lo long, hi long").distinct(), "ngram-pairs")
    sides = wanted.select("grp", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("mine"))
    dealt = common.written(one.unionByName(sides.join(spread, ["grp", "mine"]).select("grp", "lo", "hi", "mine", "cls", "m")), "ngram-dealt")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            made = [word_hashes(t, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_digest(h) for h in made], pa.binary()), pa.array([shingles(h).tobytes() for h in made], pa.binary())], ["cls", "set"])

    # all texts of a wanted id are read; those of other classes find no partner in the join by class
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col))
    # groups few enough (checked) go to the readers, so texts of others move nowhere; beyond that texts are shuffled
    chosen = texts.join(common.small(groups.select("rep"), broadcast_rows), "rep", "left_semi").mapInArrow(lambda b: common.trimmed(sets(b)), "cls binary, set binary").dropDuplicates(["cls"])
    blocks = dealt.join(chosen, "cls").select("grp", "lo", "hi", "mine", "cls", "m", "set")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), cols in common.runs(batches, 3):
            raw = [np.frombuffer(s.as_buffer(), np.uint64) for s in cols[6]]  # no copies
            at, links, low = verify(cols[5].to_numpy(), raw, cols[3].to_numpy(), lo, hi, threshold)
            if len(at):
                yield pa.RecordBatch.from_arrays([cols[4].take(pa.array(at)), pa.array(links, pa.int64()), cols[4].take(pa.array(low))], ["cls", "links", "low"])

    order = ["grp", "lo", "hi"]
    found = common.written(blocks.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda b: common.trimmed(exact(b)), "cls binary, links long, low binary"), "ngram-found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = common.connected(found.select(F.col("cls").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "cls")
    linked = common.written(linked.join(same, "cls").select("cls", "component", "rep"), "ngram-linked")
    # a table of its own, so that a large component's rows meet their first through plain exchanges
    firsts = common.written(linked.groupBy("component").agg(F.min(F.struct("rep", "cls")).alias("f")).select("component", F.col("f.rep").alias("class_id"), F.col("f.cls").alias("first")), "ngram-first")
    linked = linked.join(common.small(firsts, broadcast_rows), "component").select("cls", "class_id", "first")
    result = same.join(links, "cls", "left").join(linked, "cls", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("first", "cls").alias("first")
    )
    return rows.select("id", "digest", "cls"), common.written(result.where("n_links > 0"), "ngram-result")


def _decided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with the findings of its class; a row without an id has none."""
    own = rows.withColumn("__cls", F.when(F.col("id").isNotNull(), F.col("cls")))
    return own.join(found.withColumnRenamed("cls", "__cls"), "__cls", "left")


def _kept() -> Column:
    return F.coalesce((F.col("class_id") == F.col("id")) & (F.col("first") == F.col("cls")), F.lit(True))


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``id_col, class_id, n_links, kept`` for every row of ``docs``; the smallest id of a class stays."""
    rows, found = classes(docs, id_col, text_col, **limits)
    return _decided(rows, found).select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        _kept().alias("kept"),
    )


def dropped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest`` of the rows that are not the first of their class; ``digest`` is ``text_digest``."""
    rows, found = classes(docs, id_col, text_col)
    return _decided(rows, found).where(~_kept()).select("id", "digest").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
