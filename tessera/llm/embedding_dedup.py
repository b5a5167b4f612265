"""Embedding near-dedup with a forest of random-projection trees.

Trees are fitted on a bounded sample (the ``sample`` vectors with the smallest id hash): each node splits at the
median of a random projection, and vectors within a margin of it spill into both children.  A node whose spill
would take most of it stays whole.  Where the sample thins out before leaves are small, a leaf goes on splitting along
directions of its own tree's further levels at the medians of its sample, as many levels as its share of all rows
asks for; so leaves stay small however many rows there are.  Vectors of another length than the sample's are split
along directions through the origin.  Every vector is routed through every tree; vectors are compared exactly, in
double precision, within leaves of one label.  A pair found in several leaves counts only in its first one, so
leaves return a number of links per vector and a star of links per local component, never all pairs.  Large leaves
are cut into blocks and compared block by block.  Equal vectors of a label are one class (met by a digest) and are
compared once.

Null ids or labels, null, empty or zero vectors and those with null or non-finite components link with nothing.  Every
row is a vector of its own: rows that repeat a vec_id each give a row, each counts among the links of another vector, and
among each other's where they are near.  Ids are whole numbers, or text that reads as such.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TREES = 8
SAMPLE = 32_768  # vectors that the trees are fitted on
LEAF = 400  # vectors of a leaf, about
SPILL = 0.5  # margin in standard deviations of what a linked pair's projections differ by
THIN = 32  # sample vectors of a node that are still split by a direction of its own
LEVELS = 24  # further levels at most
BLOCK = 2048  # vectors of a leaf that are compared in one task
PAIRS = 16_384  # pairs whose leaves are looked at together
THRESHOLD = 0.98


class Leaf(NamedTuple):
    """A sample leaf: its number, and the medians at which it goes on splitting along its tree's further directions."""

    number: int
    cuts: np.ndarray


class Tree(NamedTuple):
    margin: float
    root: object  # nested (direction, cut, left, right) or Leaf
    further: np.ndarray  # directions of the levels below the sample's leaves


def _directions(seed: list[int], n: int, dim: int) -> np.ndarray:
    d = np.random.default_rng(seed).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def grow(x: np.ndarray, rows: int, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 7) -> list[Tree]:
    """Trees for about ``rows`` vectors from the sample x of unit vectors."""
    margin = spill * np.sqrt(2 * max(0.0, 1 - threshold)) / np.sqrt(x.shape[1])
    each = max(rows, 1) / max(len(x), 1)  # rows that a sample vector stands for
    least = max(THIN, int(leaf / each))
    forest = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        number = iter(range(1 << 40))
        further = _directions([seed, t, 1], LEVELS, x.shape[1])

        def halves(p: np.ndarray):
            cut = float(np.median(p))
            return cut, p <= cut + margin, p > cut - margin

        def node(at: np.ndarray):
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            if len(at) > least:
                cut, left, right = halves(x[at] @ direction)
                if max(left.sum(), right.sum()) < 0.8 * len(at):
                    return direction, cut, node(at[left]), node(at[right])
            left_over, cuts = len(at) * each / leaf, []
            for d in further:
                if left_over <= 2 or len(at) < 2:
                    break
                cut, left, right = halves(x[at] @ d)
                if max(left.sum(), right.sum()) >= 0.8 * len(at):
                    break
                cuts.append(cut)
                left_over /= 2
            return Leaf(next(number), np.array(cuts))

        forest.append(Tree(margin, node(np.arange(len(x))), further))
    return forest


def _further(p: np.ndarray, cuts: np.ndarray, margin: float) -> list[list[int]]:
    """The numbers of the parts that each row falls into, by the projections p on the further directions."""
    out = [[1] for _ in range(len(p))]
    for k, cut in enumerate(cuts):
        low, high = p[:, k] <= cut + margin, p[:, k] > cut - margin
        out = [[h << 1 | side for h in had for side, yes in ((0, a), (1, b)) if yes] for had, a, b in zip(out, low, high)]
    return out


def _key(*parts: int) -> int:
    """A leaf's key of 62 bits."""
    import xxhash

    return xxhash.xxh3_64_intdigest(repr(parts)) >> 2


def route(forest: list[Tree], x: np.ndarray) -> list[list[int]]:
    """The leaf keys (ascending) of every row of x."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    for t, tree in enumerate(forest):
        todo = [(tree.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, Leaf):
                if len(node.cuts):
                    parts = _further(x[at] @ tree.further[: len(node.cuts)].T, node.cuts, tree.margin)
                    for i, own in zip(at, parts):
                        out[i].extend(_key(t, node.number, part) for part in own)
                else:
                    key = _key(t, node.number)
                    for i in at:
                        out[i].append(key)
                continue
            direction, cut, left, right = node
            p = x[at] @ direction
            todo += [(left, at[p <= cut + tree.margin]), (right, at[p > cut - tree.margin])]
    return [sorted(k) for k in out]


def route_unfitted(x: np.ndarray, rows: int, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 7) -> list[list[int]]:
    """Leaf keys of vectors of a length that no tree was fitted for: splits through the origin."""
    dim = x.shape[1]
    margin = spill * np.sqrt(2 * max(0.0, 1 - threshold)) / np.sqrt(dim)
    levels = min(LEVELS, dim, max(0, math.ceil(math.log2(max(rows, 1) / leaf))))
    out: list[list[int]] = [[] for _ in range(len(x))]
    for t in range(trees if levels else 1):
        for own, parts in zip(out, _further(x @ _directions([seed, t, 2, dim], levels, dim).T, np.zeros(levels), margin)):
            own.extend(_key(-1, dim, t, part) for part in parts)
    return [sorted(k) for k in out]


def _units_of(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two takes off what would overflow when squared, without any rounding."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(vectors: pd.Series) -> np.ndarray:
    return _units_of(np.stack([np.asarray(v, np.float64) for v in vectors]))


def _first(keys_a: np.ndarray, keys_b: np.ndarray, here: int) -> np.ndarray:
    """Whether no leaf before ``here`` holds both vectors of a pair."""
    ok = np.ones(len(keys_a), bool)
    for c in range(keys_a.shape[1]):
        col = keys_a[:, c]
        earlier = np.flatnonzero(ok & (col >= 0) & (col < here))
        if len(earlier):
            ok[earlier] &= ~(keys_b[earlier] == col[earlier, None]).any(1)
    return ok


def link_block(x: np.ndarray, side: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j or across the two sides) whose cosine reaches the threshold, a strip at a time."""
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    for i in range(0, len(left), 512):
        a, b = np.nonzero(x[left[i : i + 512]] @ x[right].T >= threshold)
        a = a + i
        if same:
            a, b = a[a < b], b[a < b]
        yield left[a], right[b]


def local_components(n: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For each of n items the smallest index reachable through the links a-b, and those that ``known`` stands for: the same
    of links seen before."""
    low = np.arange(n)
    if known is not None:
        a, b = np.concatenate([a, low]), np.concatenate([b, known])
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def block_links(x: np.ndarray, side: np.ndarray, same: bool, threshold: float, keys: np.ndarray, m: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a block, or of two, its new links (weighted by m) and the smallest index that it is linked to.

    In a crowd nearly all pairs are links, so their leaves are looked at so many pairs at a time, and pairs are not kept.
    """
    n = len(x)
    links, low = np.zeros(n, np.int64), np.arange(n)
    for a, b in link_block(x, side, same, threshold):
        for i in range(0, len(a), PAIRS):
            u, v = a[i : i + PAIRS], b[i : i + PAIRS]
            new = _first(keys[u], keys[v], here)
            links += (np.bincount(u[new], m[v[new]], n) + np.bincount(v[new], m[u[new]], n)).astype(np.int64)
            low = local_components(n, u, v, low)
    return links, low


def near_dups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, block: int = BLOCK, spill: float = SPILL) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    v = F.col("v")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fit = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0) & F.col("id").isNotNull()
    # two hashes of 64 bits, the second from another start, stand for label and vector
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    base = base.withColumn("cls", F.when(fit, F.unhex(F.concat(half("label", "v"), half(F.lit(1), "v", "label")))))
    ids = base.where("cls is not null").select("cls", "id").distinct()
    same = common.written(ids.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "vec-same")
    firsts = base.where("cls is not null").withColumnRenamed("id", "rep").join(same, ["cls", "rep"]).dropDuplicates(["cls"])
    classes = common.written(firsts.select("label", "rep", "cls", "v", "m"), "vec-classes")
    # `sample` vectors at most go to the driver
    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()["v"]
    sizes = pd.Series([len(x) for x in drawn])
    dim = int(sizes.mode().iloc[0]) if len(sizes) else 0
    fitted = [np.asarray(x, np.float64) for x in drawn if len(x) == dim]
    rows = classes.count()
    forest = grow(_units(pd.Series(fitted)), rows, threshold, trees, leaf, spill) if len(fitted) > 1 else []

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [np.asarray(x, np.float64) for x in b.column(3).to_pylist()]
            keys: list = [None] * len(vs)
            for length in {len(x) for x in vs}:
                at = [i for i, x in enumerate(vs) if len(x) == length]
                x = _units(pd.Series([vs[i] for i in at]))
                for i, k in zip(at, route(forest, x) if length == dim and forest else route_unfitted(x, rows, threshold, trees, leaf, spill), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int64()))], [*b.schema.names, "keys"])

    table = common.written(classes.select("label", "cls", "m", "v").mapInArrow(routed, "label string, cls binary, m long, v array<double>, keys array<long>"), "vec-routed")
    placed = table.select("label", "cls", "v", "m", "keys", F.explode("keys").alias("leaf"))
    counts = common.written(table.select("label", F.explode("keys").alias("leaf")).groupBy("label", "leaf").count().where(F.col("count") > block), "vec-leaves")
    n = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")
    cut = placed.join(common.small(counts), ["label", "leaf"], "left").withColumn("n", n).withColumn("mine", mine)
    # a row of block i meets every block j once: in the task (min, max)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select("label", "leaf", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cls", "v", "m", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, here, lo, hi), (*_, mine, cls, vec, m, own) in common.runs(batches, 4):
            n, m = len(cls), m.to_numpy()
            if n < 2:
                continue
            x = _units_of(vec.flatten().to_numpy().reshape(n, -1))  # a leaf's vectors are of one length
            ends = own.value_lengths().to_numpy()
            keys = np.full((n, ends.max()), -1, np.int64)
            keys[np.arange(keys.shape[1]) < ends[:, None]] = own.flatten().to_numpy()
            links, low = block_links(x, np.where(mine.to_numpy() == lo, 0, 1), lo == hi, threshold, keys, m, int(here))
            at = np.flatnonzero((low != np.arange(n)) | np.isin(np.arange(n), low[low != np.arange(n)]))  # those with links
            if len(at):
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(at)), pa.array(links[at]), cls.take(pa.array(low[at]))], ["cls", "links", "low"])

    order = ["label", "leaf", "lo", "hi"]
    dealt = cut.repartition(common.partitions(spark), *order).sortWithinPartitions(*order).select(*order, "mine", "cls", "v", "m", "keys")
    found = common.written(dealt.mapInArrow(lambda b: common.trimmed(compare(b)), "cls binary, links long, low binary"), "vec-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = common.connected(found.select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()).withColumnRenamed("node", "cls")
    parts = common.written(parts.join(same, "cls").select("cls", "component", "rep"), "vec-parts")
    # a table of its own, so that a large component's rows meet their first through plain exchanges
    firsts = common.written(parts.groupBy("component").agg(F.min("rep").alias("first")), "vec-first")
    parts = parts.join(common.small(firsts), "component").select("cls", "first")
    per_class = same.join(links, "cls", "left").join(parts, "cls", "left").select("cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("first", "rep").alias("first"))
    return base.select("id", "cls").join(per_class, "cls", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first", "id").alias("component_id"),
        F.coalesce(F.col("first") == F.col("id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
