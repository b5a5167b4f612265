"""Full-text retrieval for batches of tasks: postings, BM25 top-k, pool-relative reranking, anchors."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import shared

K1, B = 1.2, 0.75  # published BM25 constants
IDENTITY, BODY = 8.0, 1.0  # column weights of recall
# Points of reranking.
EXACT_IDENTIFIER, NAME_IN_TASK, IN_NAME, IN_IDENTITY, IN_BODY, TEST_FACTOR = 80.0, 12.0, 8, 5, 1, 0.72
ANCHOR_SHARE = 0.30
COMMON = 1000  # documents from which on a term is common
CUT = 500  # documents that are cut into terms at a time
FEW = 50_000  # weights of a batch of tasks up to which documents are scored by a matrix
CELLS = 2_000_000  # of a matrix


def pool_size(limit: int) -> int:
    shared.require(1 <= limit <= 100, "limit must be between 1 and 100")
    return min(500, max(50, 5 * limit))


def identity(s: str = "") -> Column:
    return F.concat_ws(" ", *(F.col(s + c) for c in ("name", "qualname", "path", "id")))


def documents(symbols: DataFrame) -> DataFrame:
    """Search fields of symbols, their terms of name, identity and body with repeats, and the weighted length.

    Cutting texts into terms takes far longer than reading them, so they are dealt over all tasks first.  Columns of terms are
    worked out only where they are read; ``postings`` reads the fields.
    """
    fields = ["id", "name", "qualname", "path", "is_test", "source"]
    d = shared.dealt(symbols.select(*fields), "id").select(
        *fields, text.distinct_terms(F.col("name")).alias("name_terms"),
        text.search_terms(identity()).alias("identity_terms"), text.search_terms(F.coalesce("source", F.lit(""))).alias("body_terms"),
    )
    return d.withColumn("dl", F.size("identity_terms") + F.size("body_terms"))


def task_terms(tasks: DataFrame) -> DataFrame:
    """(task_id, term, pos): distinct terms of each task in the order of their first places."""
    return tasks.select("task_id", F.posexplode(text.distinct_terms(F.col("text"))).alias("pos", "term")).select("task_id", "term", "pos")


#: Term of the posting that every document has: it carries the document's length through the same pass.  Real terms are longer.
EVERY = ""


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Inverted index (id, term, dl, tf_identity, tf_body, in_name), one row of the term EVERY for each document; only
    of the given terms, if there are any.  The corpus is cut into terms once.

    A document's terms are counted where it is cut, so postings need no exchange; only where ids repeat rows of one id, term and
    length are added up.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in (batch.slice(at, CUT) for at in range(0, batch.num_rows, CUT)):
                terms, identities, bodies, named, lengths, sizes = [], [], [], [], [], []
                for name, qualname, path, key, source in zip(*(part.column(c).to_pylist() for c in ("name", "qualname", "path", "id", "source")), strict=True):
                    own, body = text.cut(" ".join(x for x in (name, qualname, path, key) if x is not None)), text.cut(source)
                    lengths.append(len(own) + len(body))
                    own, body, names = Counter(own), Counter(body), set(text.cut(name))
                    body[EVERY] = 1
                    each = [*body, *(t for t in own if t not in body)]
                    terms += each
                    identities += [own[t] for t in each] if own else [0] * len(each)
                    bodies += [body[t] for t in each]
                    named += [t in names for t in each]
                    sizes.append(len(each))
                at = np.repeat(np.arange(part.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array(terms, pa.string()), pa.array(np.repeat(np.array(lengths, np.int32), sizes)), pa.array(identities, pa.int64()), pa.array(bodies, pa.int64()), pa.array(named, pa.bool_())], ["id", "term", "dl", "tf_identity", "tf_body", "in_name"])

    rows = docs.select("id", "name", "qualname", "path", "source").mapInArrow(run, "id string, term string, dl int, tf_identity long, tf_body long, in_name boolean")
    if terms is not None:
        wanted = terms.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(EVERY,)], "term string"))
        rows = rows.join(shared.small(wanted), "term", "left_semi").select(*rows.columns)
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id", "term", "dl").agg(F.sum("tf_identity").alias("tf_identity"), F.sum("tf_body").alias("tf_body"), F.bool_or("in_name").alias("in_name"))


def term_table(docs: DataFrame) -> DataFrame:
    """(term, df, tf_identity, tf_body) of the whole corpus."""
    return postings(docs).where(F.col("term") != EVERY).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf_identity").alias("tf_identity"), F.sum("tf_body").alias("tf_body"))


class Index(NamedTuple):
    """A batch's terms, the postings of these terms, and every document's length."""

    asked: DataFrame
    hits: DataFrame
    lengths: DataFrame


def index(tasks: DataFrame, docs: DataFrame) -> Index:
    """Query terms prune the index as it is built (they are broadcast if counted few)."""
    asked = shared.written(task_terms(tasks), "task-terms")
    rows = shared.written(postings(docs, asked), "postings")
    return Index(asked, rows.where(F.col("term") != EVERY), rows.where(F.col("term") == EVERY))


def bm25(tasks: DataFrame, docs: DataFrame | None, limit: int, at: Index | None = None, common: int = COMMON) -> DataFrame:
    """(task_id, id, score, rank): the best ``limit`` documents of each task by smoothed BM25, ties by id.  ``docs`` may be
    missing where there is an index.

    Scores are summed where a document's hits lie, and each partition keeps its own best rows before the ranking
    exchange.  Where tasks and their terms are few a document is scored for all of them at once; where many tasks have the same
    terms of more than ``common`` documents, these are ranked once for all of them.
    """
    at = at or index(tasks, docs)
    whole = at.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))  # one row
    df = at.hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = at.asked.join(df, "term").join(F.broadcast(whole)).select("task_id", "term", idf.alias("idf"), "avg_dl", (F.col("df") > common).alias("common"))
    weights = shared.written(weights, "weights")
    n = weights.agg(*_sizes(), F.first("avg_dl").alias("avg_dl")).first()
    if _few(n):
        tf = IDENTITY * F.col("tf_identity") + BODY * F.col("tf_body")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(n.avg_dl)))
        best = _leading(at.hits.select("id", "term", part.alias("part")), weights, limit).where("n is null").drop("n")
        return shared.top(best, ["task_id"], [F.desc("score"), F.col("id")], limit)
    sets = weights.where("common").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("set"))
    n = sets.agg(F.count("*").alias("tasks"), F.countDistinct("set").alias("sets")).first()
    if 2 * n.sets >= n.tasks:  # hardly any two tasks have all their common terms alike
        return shared.top(_scored(at.hits, weights, "task_id"), ["task_id"], [F.desc("score"), F.col("id")], limit)
    return shared.top(_scored_by_sets(at.hits, weights, shared.written(sets, "common-terms"), limit), ["task_id"], [F.desc("score"), F.col("id")], limit)


def _part() -> Column:
    """What one term gives to a document's score."""
    tf = IDENTITY * F.col("tf_identity") + BODY * F.col("tf_body")
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))


def _sizes() -> list[Column]:
    return [F.count("*").alias("weights"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("term").alias("terms")]


def _few(n) -> bool:
    return n.weights <= FEW and n.tasks * n.terms <= CELLS


#: What stands before a spelling, before a name and for a test, where these go with the terms of a document: no term begins so.
EXACT, INSIDE, TEST = "=", "@", "!"


def _leading(hits: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """(task_id, id, score, n) of all documents that can be among a task's best ``limit``, for at most FEW weights; and of
    each partition a row with how many documents have points for the task (n, without an id).

    Hits (id, term, part) meet weights (task_id, term, idf).  Any of a task's spellings (EXACT) gives its points once, and so
    does a name (INSIDE); TEST takes a share away.  Pairs of tasks and documents are far more than hits: a document's hits meet the weights of all tasks as a product of
    matrices, and a pair leaves its partition only if fewer than ``limit`` documents there are surely better.  The weights, a
    counted few, pass through the driver as those of a broadcast do.
    """
    import numpy as np
    import pyarrow as pa

    asked = weights.toArrow()
    task_ids, terms = asked["task_id"].combine_chunks().unique(), asked["term"].combine_chunks().unique()
    table = np.zeros((len(terms), len(task_ids)))
    place = lambda values: np.asarray(values.combine_chunks().dictionary_encode().indices)
    table[place(asked["term"]), place(asked["task_id"])] = np.asarray(asked["idf"])
    begins = np.array([t[:1] for t in terms.to_pylist()], dtype="U1")
    marks = [(m, np.nonzero(begins == m)[0]) for m in (EXACT, INSIDE, TEST)]
    plain = np.where(np.isin(begins, (EXACT, INSIDE, TEST))[:, None], 0.0, table)
    width = max(1, len(terms))
    docs = max(1, CELLS // max(width, len(task_ids), 1))  # of one matrix

    def run(batches):
        import pyarrow.compute as pc

        best, total = np.zeros((limit, len(task_ids))), np.zeros(len(task_ids), np.int64)

        def score(rows: pa.Table):
            nonlocal best, total
            ids = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode")
            row, column = np.asarray(ids.indices), np.asarray(pc.fill_null(pc.index_in(rows["term"], value_set=terms), -1))
            part = np.asarray(rows["part"])
            for first in range(0, len(ids.dictionary), docs):
                here, n = (row >= first) & (row < first + docs) & (column >= 0), min(docs, len(ids.dictionary) - first)
                cells = np.bincount((row[here] - first) * width + column[here], weights=part[here], minlength=n * width).reshape(n, width)
                scores = cells @ plain
                for mark, at in marks:
                    if len(at):
                        marked = cells[:, at] @ table[at] > 0
                        scores = np.where(marked, scores * TEST_FACTOR, scores) if mark == TEST else scores + marked * (EXACT_IDENTIFIER if mark == EXACT else NAME_IN_TASK)
                total += (scores > 0).sum(axis=0)
                best = np.partition(np.vstack([best, scores]), -limit, axis=0)[-limit:]
                # rounding may make the order of scores this near that of their ids
                which, whose = np.nonzero((scores > 0) & (scores >= best.min(axis=0) - 0.0011))
                yield pa.RecordBatch.from_arrays([task_ids.take(pa.array(whose)), ids.dictionary.take(pa.array(which + first)), pa.array(scores[which, whose]), pa.nulls(len(which), pa.int64())], names)

        rest = None  # the hits of a document may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            ids = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices
            start = int(np.argmax(np.asarray(ids) == ids[-1].as_py()))
            if start:
                yield from score(rows.slice(0, start))
            rest = rows.slice(start)
        if rest is not None:
            yield from score(rest)
            yield pa.RecordBatch.from_arrays([task_ids, pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.float64()), pa.array(total)], names)

    names, kind = ["task_id", "id", "score", "n"], weights.schema["task_id"].dataType.simpleString()
    near = shared.dealt(hits.select("id", "term", "part"), "id").sortWithinPartitions("id").mapInArrow(run, f"task_id {kind}, id string, score double, n long")
    return near.withColumn("score", F.round("score", 3))


def _scored(hits: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """(by, id, score).  Hits are dealt by id, so that pairs, which are far more, need no exchange and fall on all tasks."""
    return shared.dealt(hits, "id").join(shared.small(weights), "term").groupBy(by, "id").agg(F.round(F.sum(_part()), 3).alias("score"))


def _scored_by_sets(hits: DataFrame, weights: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """(task_id, id, score) of all documents that can be among a task's best ``limit``.

    A common term meets as many pairs of tasks and documents as the product of both, so documents that share only common
    terms with a task are ranked once for each set of such terms.  A document with a rarer term gets its whole score; it
    may stand in its set's ranking too, with a score that is not greater, and so pushes out none that belongs there.
    """
    of_sets = weights.where("common").join(sets, "task_id").select("set", "term", "idf", "avg_dl").distinct()
    of_sets = shared.written(of_sets, "weights-of-sets")
    # hits of common terms take part by themselves: they are most of all
    parts = shared.written(hits.join(shared.small(of_sets.select("term", "idf", "avg_dl").distinct()), "term").select("id", "term", _part().alias("part")), "common-parts")
    by_set = lambda rows, *on: rows.join(shared.small(of_sets.select("set", "term")), [*on, "term"]).groupBy("set", "id").agg(F.sum("part").alias("part"))
    leading = by_set(parts).select("set", "id", F.round("part", 3).alias("score"))
    leading = shared.written(shared.top(leading, ["set"], [F.desc("score"), F.col("id")], limit).drop("rank"), "best-of-sets")
    rare = hits.join(shared.small(weights.where("not common")), "term").groupBy("task_id", "id").agg(F.sum(_part()).alias("rare"))
    rare = shared.written(rare.join(shared.small(sets), "task_id", "left"), "rare-hits")
    met = by_set(rare.where("set is not null").select("set", "id").distinct().join(parts, "id"), "set")
    whole = rare.join(met, ["set", "id"], "left").select("task_id", "id", F.round(F.col("rare") + F.coalesce("part", F.lit(0.0)), 3).alias("score"))
    # tasks are few bytes and lie in one file, their rows are many: they are dealt first, and then once for all that follows
    both = whole.unionByName(shared.dealt(sets, "task_id").join(shared.small(leading), "set").select("task_id", "id", "score"))
    return shared.dealt(both, "task_id").groupBy("task_id", "id").agg(F.max("score").alias("score"))


def pin_exact(pool: DataFrame, exact: DataFrame) -> DataFrame:
    """Candidates (task_id, id) with the symbols that the task names, each once."""
    return exact.select("task_id", "id").unionByName(pool.select("task_id", "id")).distinct()


def _weight() -> Column:
    return F.when(F.col("in_name"), IN_NAME).when(F.col("tf_identity") > 0, IN_IDENTITY).otherwise(IN_BODY)


def spellings(symbols: DataFrame) -> DataFrame:
    """(id, is_test, name, keys): a symbol's names as a task may spell them, lower-cased."""
    local = F.regexp_extract("id", r"^(?:.*?::)?(.*)$", 1)
    return symbols.select("id", "is_test", F.lower("name").alias("name"), F.array_distinct(F.array(*(F.lower(c) for c in ("name", "qualname", "id")), F.lower(local))).alias("keys"))


def _about_tests() -> Column:
    return F.arrays_overlap(text.distinct_terms(F.col("text")), F.array(F.lit("test"), F.lit("tests"), F.lit("测试")))


def _evidence() -> Column:
    """Why a symbol is found, from the columns exact, named_in and ev."""
    none = F.array().cast("array<string>")
    every = F.concat(
        F.when(F.col("exact"), F.array(F.lit("exact-identifier"))).otherwise(none), F.when(F.col("named_in"), F.array(F.lit("exact-name"))).otherwise(none),
        F.coalesce(F.transform(F.array_sort("ev"), lambda e: e.term), none),
    )
    return F.slice(F.array_distinct(every), 1, 8)


def _ranked(found: DataFrame, tasks: DataFrame, limit: int, pooled: bool = False) -> DataFrame:
    """From (task_id, id, is_test, lexical, ev, exact, named_in): points, evidence, total, the best ``limit``.  Rows of
    bounded pools are written, so that they are worked out once for both."""
    about = tasks.select("task_id", _about_tests().alias("about_tests"))
    raw = F.coalesce("lexical", F.lit(0.0)) + F.when(F.col("exact"), EXACT_IDENTIFIER).otherwise(0.0) + F.when(F.col("named_in"), NAME_IN_TASK).otherwise(0.0)
    out = found.join(shared.small(about), "task_id").withColumn("raw", raw).where("raw > 0")
    out = out.withColumn("score", F.round(F.when(F.col("is_test") & ~F.col("about_tests"), F.col("raw") * TEST_FACTOR).otherwise(F.col("raw")), 3))
    out = out.withColumn("evidence", _evidence()).select("task_id", "id", "score", "evidence")
    if pooled:
        out = shared.written(out, "ranked")
    total = out.groupBy("task_id").agg(F.count("*").alias("total"))
    return shared.top(out, ["task_id"], [F.desc("score"), F.col("id")], limit).join(shared.small(shared.written(total, "totals")), "task_id")


def _rarity(hits: DataFrame, asked: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    df = hits.groupBy(*by).agg(F.count("*").alias("df"))
    idf = F.log((F.col("pool") + 1) / (F.col("df") + 1)) + 1
    return asked.join(df, by).join(sizes, "task_id").select("task_id", "term", "pos", idf.alias("idf"))


def _terms_found(hits: DataFrame, asked: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(task_id, id, lexical, ev): weighted terms; their rarity is measured among the documents that ``by`` names."""
    rare = _rarity(hits, asked, sizes, by)
    met = hits.join(shared.small(rare), by) if "task_id" in by else hits.join(shared.small(rare), "term")
    return met.groupBy("task_id", "id").agg(F.sum(F.col("w") * F.col("idf")).alias("lexical"), F.collect_list(F.struct("pos", "term")).alias("ev"))


def rerank(tasks: DataFrame, symbols: DataFrame, pool: DataFrame, limit: int, at: Index) -> DataFrame:
    """Rank a pool (task_id, id) by weighted terms whose rarity is measured in the task's own pool.

    Returns task_id, id, score (3 places), evidence (at most 8), total, rank.  The weight of the path alone never
    applies, since the identity holds the path.  Terms come from the batch's postings by an equi-join on the pool's
    ids; whole texts take no part.
    """
    pool = shared.written(pool.select("task_id", "id").distinct(), "pool")
    sizes = pool.groupBy("task_id").agg(F.count("*").alias("pool"))
    near = at.hits.join(shared.small(pool.select("id").distinct()), "id", "left_semi").select("id", "term", _weight().alias("w"))
    hits = shared.written(pool.join(at.asked.select("task_id", "term"), "task_id").join(near, ["id", "term"]), "pool-hits")
    scored = _terms_found(hits, at.asked, sizes, ["task_id", "term"])
    asked = tasks.select("task_id", F.lower("text").alias("folded"), F.transform(text.task_identifiers(F.col("text")), F.lower).alias("named"))
    who = pool.join(spellings(symbols), "id").join(shared.small(asked), "task_id")
    who = who.select("task_id", "id", "is_test", F.arrays_overlap("keys", "named").alias("exact"), F.col("folded").contains(F.col("name")).alias("named_in"))
    return _ranked(who.join(scored, ["task_id", "id"], "left"), tasks, limit, pooled=True)


def rank_all(tasks: DataFrame, symbols: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """The same ranking with the whole corpus as every task's pool, without a recall stage.

    A symbol gets points by a term that it shares (an equi-join with the postings), by a spelling that the task names
    (an equi-join on names) or by a name that stands in the task's text (an equi-join on pieces of the text); symbols
    with none of these have no points, so no task meets a symbol that it has nothing in common with.
    """
    from .lookup import find_all

    at = index(tasks, docs)
    hits = at.hits.select("id", "term", _weight().alias("w"))
    sizes = tasks.select("task_id").distinct().join(F.broadcast(at.lengths.agg(F.count("*").alias("pool"))))  # one row
    who = shared.written(spellings(symbols), "spellings")
    named = shared.written(tasks.select("task_id", F.explode(F.array_distinct(F.transform(text.task_identifiers(F.col("text")), F.lower))).alias("key")), "named")
    exact = who.select("id", F.explode("keys").alias("key")).join(shared.small(named), "key").select("task_id", "id").distinct()
    # a name is sought in the distinct texts, which stand as ids here
    texts = shared.written(tasks.select("task_id", "text"), "task-texts")
    inside = find_all(who.select(F.col("name").alias("query")).distinct(), texts.select(F.col("text").alias("id"), F.lit("").alias("name")).distinct())
    inside = inside.select(F.col("query").alias("name"), F.col("id").alias("text")).join(texts, "text").select("task_id", "name")
    inside_tasks = shared.written(inside, "names-inside")
    inside = who.select("id", "name").join(shared.small(inside_tasks), "name").select("task_id", "id")
    if who.groupBy("id").count().where("count > 1").isEmpty():
        of = lambda mark, c: F.concat(F.lit(mark), F.col(c)).alias("term")
        about = tasks.where(~_about_tests()).select("task_id", F.lit(TEST).alias("term"))
        marks = named.select("task_id", of(EXACT, "key")).unionByName(inside_tasks.select("task_id", of(INSIDE, "name"))).unionByName(about).where("term is not null").distinct()
        weights = shared.written(_rarity(hits, at.asked, sizes, ["term"]).select("task_id", "term", "idf").unionByName(marks.withColumn("idf", F.lit(1.0))), "weights")
        if _few(weights.agg(*_sizes()).first()):
            have = who.select("id", F.explode(F.concat(F.transform("keys", lambda k: F.concat(F.lit(EXACT), k)), F.array(of(INSIDE, "name"), F.when(F.col("is_test"), TEST)))).alias("term"))
            have = hits.select("id", "term", F.col("w").cast("double").alias("part")).unionByName(have.withColumn("part", F.lit(1.0)))
            met = shared.written(_leading(have.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi"), weights, limit), "leading")
            total = met.where("n is not null").groupBy("task_id").agg(F.sum("n").alias("total"))
            best = shared.written(shared.top(met.where("n is null").drop("n"), ["task_id"], [F.desc("score"), F.col("id")], limit), "best")
            # only the best need their evidence
            ev = hits.join(F.broadcast(best.select("task_id", "id")), "id").join(F.broadcast(at.asked), ["task_id", "term"]).groupBy("task_id", "id").agg(F.collect_list(F.struct("pos", "term")).alias("ev"))
            flag = lambda rows, c: rows.join(F.broadcast(best.select("task_id", "id")), ["task_id", "id"], "left_semi").distinct().withColumn(c, F.lit(True))
            for more in (ev, flag(exact, "exact"), flag(inside, "named_in")):
                best = best.join(more, ["task_id", "id"], "left")
            return best.withColumn("evidence", _evidence()).join(total, "task_id").select("task_id", "id", "score", "evidence", "total", "rank")
    scored = _terms_found(hits, at.asked, sizes, ["term"]).select("task_id", "id", "lexical", "ev")
    none = F.lit(None)
    rows = scored.select("task_id", "id", "lexical", "ev", F.lit(False).alias("exact"), F.lit(False).alias("named_in"))
    rows = rows.unionByName(exact.select("*", none.cast("double").alias("lexical"), none.cast(rows.schema["ev"].dataType).alias("ev"), F.lit(True).alias("exact"), F.lit(False).alias("named_in")))
    rows = rows.unionByName(inside.select("*", none.cast("double").alias("lexical"), none.cast(rows.schema["ev"].dataType).alias("ev"), F.lit(False).alias("exact"), F.lit(True).alias("named_in")))
    found = rows.groupBy("task_id", "id").agg(F.max("lexical").alias("lexical"), F.first("ev", ignorenulls=True).alias("ev"), F.bool_or("exact").alias("exact"), F.bool_or("named_in").alias("named_in"))
    return _ranked(found.join(who.select("id", "is_test"), "id"), tasks, limit)


def task_matches(tasks: DataFrame, symbols: DataFrame, exact: DataFrame | None = None, limit: int = 20, at: Index | None = None) -> DataFrame:
    """Recall by BM25, pinning of named symbols (task_id, id), reranking in the pool; one index serves both.  With a stored
    index (see ``stored.index``) no source is read."""
    at = at or index(tasks, documents(symbols))
    pool = bm25(tasks, None, pool_size(limit), at)
    return rerank(tasks, symbols, pool if exact is None else pin_exact(pool, exact), limit, at)


def above_threshold(matches: DataFrame) -> DataFrame:
    """Matches that reach the threshold share of their task's best score."""
    best = F.max("score").over(Window.partitionBy("task_id"))
    return matches.withColumn("threshold", best * ANCHOR_SHARE).where(F.col("score") >= F.col("threshold"))


def anchors(matches: DataFrame) -> DataFrame:
    """(task_id, id, rank, score, evidence): from the best match on, those that reach the threshold share of the first one's
    score and neither hold one another nor are held, up to the task's number (most); a preferred match stands alone.

    A fold over a task's matches (task_id, id, score, evidence, preferred, most), which recall bounds.
    """
    item = F.struct((~F.col("preferred")).alias("after"), (-F.col("score")).alias("minus"), "id", "score", "evidence")
    rows = matches.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("m"), F.max("most").alias("most"))
    first = F.get("m", 0)
    rows = rows.withColumn("least", first.score * ANCHOR_SHARE).withColumn("most", F.when(first.after, F.col("most")).otherwise(1))

    def take(kept: Column, x: Column) -> Column:
        within = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
        related = F.exists(kept, lambda a: within(x.id, a.id) | within(a.id, x.id))
        return F.when((F.size(kept) < F.col("most")) & (x.score >= F.col("least")) & ~related, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("m", F.slice("m", 1, 0), take)
    return rows.select("task_id", F.posexplode(kept).alias("rank", "a")).select("task_id", "a.id", "rank", "a.score", "a.evidence")


# ---- definitions found by name, and an edit's surroundings

# A definition of one of the names that stand for {0}.
DEFINITION = (
    r"(?is)\b(?:def|class|fn|function|interface|struct|enum|trait|type)\s+({0})(?![A-Za-z0-9_])|\b(?:const|let|var)\s+({0})\s*[=:]"
    r"|(?<![A-Za-z0-9_])({0})\s*\([^;{}]{0,1000}\)\s*(?:\{|;|=>|:)"
)
# Folders of other people's code.
VENDOR = ["deps", "vendor", "third_party", "third-party"]
TEST_MARKS = ["test", "spec", "__tests__", "testing"]
BEFORE, AFTER = 6, 7  # lines around a reference
READ_TESTS, READ_NEAR, READ_FAR = 6, 4, 4  # files that are looked into, by kind


def defining_files(tasks: DataFrame, files: DataFrame, names: Column | None = None) -> DataFrame:
    """(task_id, path): raw files (path, text) that define a name of a task, found before any parsing.

    One pass over the files' words meets the names of all tasks by an equi-join: a plain name by itself, a dotted one by
    the part before its last, which its file must hold as well.  Only texts of files that hold such a word are matched
    against the forms of a definition, for that name alone.  A task with a dotted name takes only files that define one
    of its dotted names.  Tasks and texts are dealt over all tasks of Spark, as cutting them takes longer than reading.
    """
    if names is None:
        tasks, names = shared.dealt(tasks.select("task_id", "text"), "task_id"), text.task_identifiers(F.col("text"))
    asked = shared.written(tasks.select("task_id", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("value")), "asked-names")
    files = shared.dealt(files.select("path", "text"), "path")
    values = asked.select("value").distinct().select("value", F.element_at(F.split("value", r"\."), -1).alias("leaf"), F.element_at(F.slice(F.reverse(F.split("value", r"\.")), 1, 2), -1).alias("word"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1)))
    held = files.select("path", F.explode(words).alias("word")).join(shared.small(shared.written(values, "name-words")), "word").select("path", "value", "leaf")
    held = shared.written(held, "files-with-names")
    pattern = F.replace(F.lit(DEFINITION), F.lit("{0}"), F.col("leaf"))
    defined = files.join(shared.small(held), "path").where(F.rlike("text", pattern)).select("path", "value")
    met = asked.join(defined, "value").withColumn("dotted", F.col("value").contains("."))
    found = met.groupBy("task_id", "path").agg(F.bool_or("dotted").alias("dotted"))
    qualified = asked.groupBy("task_id").agg(F.bool_or(F.col("value").contains(".")).alias("qualified"))
    return found.join(qualified, "task_id").where("dotted or not qualified").select("task_id", "path")


def exact_definitions(tasks: DataFrame, symbols: DataFrame, within: DataFrame | None = None, names: Column | None = None) -> DataFrame:
    """(task_id, id, place): the symbols that a task names, best first; one for a task with one name, else two.

    Production code goes first, then code that is not a vendor's, bodies before declarations, paths whose parts the task
    mentions, short paths, ids.  ``within`` (task_id, path), see ``defining_files``, says which files count for a task;
    ``names`` are the tasks' identifiers where they are known.
    """
    if names is None:
        tasks, names = shared.dealt(tasks.select("task_id", "text"), "task_id"), text.task_identifiers(F.col("text"))
    asked = tasks.select("task_id", F.lower("text").alias("folded"), F.size(names).alias("n"), F.explode(names).alias("name"))
    asked = asked.withColumn("leaf", F.lower(F.regexp_extract("name", r"([^.]*)$", 1))).withColumn("name", F.lower("name"))
    # symbols of one spelling, path and kind differ by their ids alone, so two of them stand for all before they meet tasks
    declares = F.col("language").isin("c", "cpp") & F.trim("source").endswith(";")
    own = symbols.select("id", F.lower("name").alias("leaf"), F.lower("qualname").alias("qual"), "path", "is_test", declares.alias("declares"))
    alike = ["path", "is_test", "declares"]
    fewest = lambda df, *by: shared.top(df.select("id", *by, *alike).distinct(), [*by, *alike], [F.col("id")], 2, "nth").drop("nth")
    # a dotted name is met by each dotted end of a symbol's whole name
    parts = F.split("qual", r"\.")
    ends = own.where("leaf is not null").withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))))
    dotted = F.col("name").contains(".")
    met = asked.where(~dotted).join(shared.small(shared.written(fewest(own, "leaf"), "plain-names")), "leaf").drop("leaf", "name")
    met = met.unionByName(asked.where(dotted).join(fewest(ends.where(dotted), "leaf", "name"), ["leaf", "name"]).drop("leaf", "name"))
    if within is not None:
        met = met.join(within, ["task_id", "path"], "left_semi")
    parts = F.split(F.lower("path"), "/")
    said = F.size(F.filter(F.array_distinct(parts), lambda p: (F.length(p) >= 3) & F.replace(F.col("folded"), F.lit("\\"), F.lit("/")).contains(p)))
    order = [F.col("is_test"), F.arrays_overlap(parts, F.array(*map(F.lit, VENDOR))), F.col("declares"), F.desc(said), F.size(parts), F.col("id")]
    once = met.dropDuplicates(["task_id", "id"])
    best = shared.top(once, ["task_id"], order, 2, "place")
    return best.where((F.col("n") > 1) | (F.col("place") == 1)).select("task_id", "id", "place")


def reference_windows(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, role, path, line, first, last, source): where other files name a target (task_id, path, name), as windows
    of lines: the first two tests and the first caller.

    Files (path, text) meet targets by their words; tests go first, then files of the target's folder, then short and
    small paths.  So many tests, neighbours and other files are looked into at most, by name order.
    """
    word = r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)"
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    asked = targets.select("task_id", F.col("path").alias("own"), F.lower("name").alias("leaf"))
    low = files.select("path", "text", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(1))).alias("words"))
    hits = low.select("path", F.explode("words").alias("leaf")).join(shared.small(asked), "leaf").where(F.col("path") != F.col("own"))
    test = F.exists(F.array(*map(F.lit, TEST_MARKS)), lambda m: F.lower("path").contains(m))
    ranked = hits.select("task_id", "leaf", "path", test.alias("is_test"), (folder(F.col("path")) == folder(F.col("own"))).alias("near"), F.size(F.split("path", "/")).alias("depth"))
    kind = F.when(F.col("is_test"), 0).when(F.col("near"), 1).otherwise(2)
    most = F.when(F.col("kind") == 0, READ_TESTS).when(F.col("kind") == 1, READ_NEAR).otherwise(READ_FAR)
    order = [~F.col("near"), F.col("depth"), F.lower("path"), F.col("path")]
    ranked = ranked.withColumn("kind", kind)
    read = shared.top(ranked, ["task_id", "kind"], order, max(READ_TESTS, READ_NEAR, READ_FAR)).where(F.col("rank") <= most)
    first = Window.partitionBy("task_id", "is_test").orderBy("kind", "rank")
    kept = read.withColumn("i", F.row_number().over(first)).where((F.col("i") <= 2) & F.col("is_test") | (F.col("i") == 1))
    met = kept.join(files.select("path", "text"), "path")
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    at = F.array_position(F.transform(lines, lambda line: F.array_contains(F.regexp_extract_all(F.lower(line), F.lit(word), F.lit(1)), F.col("leaf"))), True) - 1
    out = met.withColumn("lines", lines).withColumn("at", at.cast("int")).where("at >= 0")
    start, stop = F.greatest(F.lit(0), F.col("at") - BEFORE), F.least(F.size("lines"), F.col("at") + AFTER)
    return out.select(
        "task_id", F.when(F.col("is_test"), "test").otherwise("caller").alias("role"), "path", (F.col("at") + 1).alias("line"), (start + 1).alias("first"), stop.alias("last"),
        F.array_join(F.slice("lines", start + 1, stop - start), "\n").alias("source"),
    )


def nearby_symbols(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, id, role, place): symbols of a target's own file that its source names (the two shortest), and the
    shortest declaration of its name elsewhere.  ``targets``: (task_id, id)."""
    t = targets.join(symbols.select("id", F.col("path").alias("own"), F.lower("name").alias("leaf"), F.lower("source").alias("body")), "id").select("task_id", F.col("id").alias("target"), "own", "leaf", "body")
    words = F.regexp_extract_all("body", F.lit(r"(?U)(\w+)"), F.lit(1))
    s = symbols.select("id", "path", F.lower("name").alias("name"), F.length("source").alias("size"), F.trim("source").endswith(";").alias("declares"))
    s = shared.written(s, "near-names")
    # of equal names only the shortest can be picked: as many as are asked for, and those that a target may rule out (itself
    # and what it stands in, each as often as an id repeats)
    dots = targets.agg(F.coalesce(F.max(F.size(F.split("id", r"\.")) - 1), F.lit(0))).first()[0]
    repeats = s.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    fewest = lambda df, by, n: shared.small(shared.written(shared.top(df, by, [F.col("size"), F.col("id")], n, "nth").drop("nth"), "shortest-names"))
    outside = (F.col("id") != F.col("target")) & ~F.startswith(F.col("target"), F.concat("id", F.lit(".")))
    said = shared.dealt(t, "task_id").select("task_id", "target", F.col("own").alias("path"), F.explode(F.array_distinct(words)).alias("name")).where(F.length("name") >= 3)
    near = said.join(fewest(s.where(F.length("name") >= 3), ["path", "name"], 2 + (1 + dots) * repeats), ["path", "name"]).where(outside)
    declared = t.join(fewest(s.where("declares"), ["name"], 1 + repeats), F.col("leaf") == F.col("name")).where(F.col("id") != F.col("target"))
    pick = lambda df, role, n: shared.top(df, ["task_id"], [F.col("size"), F.col("id")], n, "place").select("task_id", "id", F.lit(role).alias("role"), "place")
    return pick(near, "dependency", 2).unionByName(pick(declared, "declaration", 1))
