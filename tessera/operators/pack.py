"""Budgeted selection of evidence: candidates, packing, sufficiency, routing and the final decision."""

from __future__ import annotations

from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import shared

# Cost of a role's block besides its bytes, and the selection constants.
ROLE_COST = {"task-anchor": 0, "test": 40, "dependency": 100, "parent": 120, "caller": 160}
OVERLAP_PENALTY, NOVELTY_FLOOR, VALUE_FLOOR = 260.0, 0.15, 2.0
FRONTIER_BASE = {"declaration": 900, "dependency": 800, "test": 820, "caller": 620}
FRONTIER_COST = {"declaration": 60, "dependency": 100, "test": 40, "caller": 160}
READ_COST, SEARCH_COST, FILE_COST, FILE_CAP, ENVELOPE, FOLLOWUP, MARGIN = 320, 160, 2, 1200, 420, 600, 0.15
# Bytes from which an anchor is cut, bounds of what is left of it, letters of a term that counts.
EXCERPT_FROM, EXCERPT_LEAST, EXCERPT_MOST, LEAST_TERM = 1400, 700, 2000, 3

CANDIDATE = ["task_id", "id", "score", "role", "detail"]


def _row(df: DataFrame, id_col: str, score: Column, role: str, detail: Column, offer: int) -> DataFrame:
    return df.select("task_id", F.col(id_col).alias("id"), score.cast("double").alias("score"), F.lit(role).alias("role"), detail.alias("detail"), F.lit(offer).alias("offer"), F.col("rank").alias("anchor"))


def task_candidates(anchors: DataFrame, symbols: DataFrame, edges: DataFrame, tests: DataFrame, intent: str, behavior: bool = False, once: bool = False) -> DataFrame:
    """Anchors (task_id, id, rank from 0, score, evidence) with parents, dependencies, callers and tests.

    ``edges`` are resolved; ``tests`` (task_id, anchor_id, id, rank) are those found relevant.  Each symbol keeps its
    best offer; of equal offers the first one, in the order anchor by anchor and role by role.  With ``once`` offers are dealt by
    symbol, so that they need no further exchange to meet their symbols in ``render``.
    """
    rank = F.col("rank")
    known = shared.written(anchors.join(symbols.select("id", "path", "parent"), "id"), "anchors")  # read by four roles
    outline = F.lit("outline")
    detail = F.lit("outline") if intent in ("impact", "test") else F.when((rank == 0) | F.array_contains("evidence", "exact-name"), "full").otherwise("outline")
    out = _row(known, "id", 1200 - rank * 80 + F.least(F.col("score"), F.lit(100.0)), "task-anchor", detail, 0)
    out = out.unionByName(_row(known.where("parent is not null"), "parent", 900 - rank * 20, "parent", outline, 1))
    if intent in ("understand", "edit", "impact"):
        e = known.select("task_id", "rank", F.col("id").alias("source")).join(edges.where("target is not null"), "source")
        out = out.unionByName(_row(e, "target", 720 - rank * 20 + F.when(F.col("kind") == "call", 12).otherwise(4), "dependency", F.lit("full" if behavior else "outline"), 2))
    if intent in ("edit", "impact"):
        e = known.select("task_id", "rank", F.col("id").alias("target"), F.col("path").alias("own")).join(edges.where("target is not null").select("source", "target"), "target")
        w = Window.partitionBy("task_id", "target").orderBy(F.substring_index("source", "::", 1) != F.col("own"), "source")
        out = out.unionByName(_row(e.withColumn("n", F.row_number().over(w)).where("n <= 4"), "source", 640 - rank * 20, "caller", outline, 3))
    if intent in ("edit", "impact", "test"):
        out = out.unionByName(_row(tests, "id", 820 - rank * 20, "test", F.lit("full" if intent in ("edit", "test") else "outline"), 4))
    out = shared.dealt(out, "id") if once else out
    return shared.top(out, ["task_id", "id"], [F.desc("score"), F.col("anchor"), F.col("offer")], 1, "best").select(*CANDIDATE)


def symbol_candidates(targets: DataFrame, symbols: DataFrame, edges: DataFrame, tests: DataFrame, intent: str) -> DataFrame:
    """Candidates around one symbol a task (task_id, id): fixed scores by role, more for repeated edges."""
    t = targets.join(symbols.select("id", "parent"), "id").withColumn("rank", F.lit(0))
    outline = F.lit("outline")
    out = _row(t, "id", F.lit(1000), "target", F.lit("outline" if intent in ("impact", "test") else "full"), 0)
    out = out.unionByName(_row(t.where("parent is not null"), "parent", F.lit(900), "parent", outline, 1))
    live = edges.where("target is not null")
    ids = t.select("task_id", F.col("id").alias("own"), "rank")
    if intent in ("understand", "edit", "impact"):
        w = ids.join(live, F.col("own") == F.col("source")).groupBy("task_id", "rank", "target").agg(F.sum(F.when(F.col("kind") == "call", 3).otherwise(1)).alias("w"))
        out = out.unionByName(_row(w, "target", 700 + F.least(F.col("w"), F.lit(30)), "dependency", outline, 2))
    if intent in ("edit", "impact"):
        w = ids.join(live, F.col("own") == F.col("target")).groupBy("task_id", "rank", "source").agg(F.count("*").alias("w"))
        out = out.unionByName(_row(w, "source", 600 + F.least(F.col("w"), F.lit(30)), "caller", outline, 3))
    if intent in ("edit", "impact", "test"):
        out = out.unionByName(_row(tests.withColumn("rank", F.lit(0)), "id", F.lit(800), "test", F.lit("full" if intent == "test" else "outline"), 4))
    return shared.top(out, ["task_id", "id"], [F.desc("score"), F.col("offer")], 1, "best").select(*CANDIDATE)


def render(candidates: DataFrame, symbols: DataFrame, tasks: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Candidates with their block of text, its bytes and its terms.

    With tasks (task_id, text, budget), an anchor that would take half of its task's budget is cut to the lines that
    matter for the task.  With ``once`` (without tasks) both texts of a symbol are cut into terms before candidates meet
    it: for batches that name most symbols, and many of them often.
    """
    s = symbols.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("signature", F.concat_ws(" ", "kind", "qualname")).alias("head"), "hash")
    full, outline = F.col("source"), F.concat("head", F.lit(" ..."))
    of_detail = lambda a, o: F.when(F.col("detail") == "full", a).otherwise(o)
    if once:
        shared.require(tasks is None, "excerpts differ by task")
        s = shared.dealt(s, "id").select("id", "hash", *(x for n, t in (("__full", text.rstrip(full)), ("__outline", text.rstrip(outline))) for x in (t.alias(n), text.distinct_terms(t).alias(n + "_terms"))))
        out = candidates.join(s, "id").withColumn("body", of_detail(F.col("__full"), F.col("__outline"))).withColumn("terms", of_detail(F.col("__full_terms"), F.col("__outline_terms")))
        return _as_blocks(out).drop("__full", "__full_terms", "__outline", "__outline_terms")
    out = candidates.join(s, "id")
    if tasks is not None:
        out = out.join(tasks.select("task_id", F.col("text").alias("__asked"), F.expr("budget div 2").cast("int").alias("__half")), "task_id")
        terms, names = F.filter(text.search_terms(F.col("__asked")), lambda t: F.length(t) >= LEAST_TERM), F.transform(text.task_identifiers(F.col("__asked")), F.lower)
        lines = text.excerpt_lines(F.col("source"), terms, names, F.greatest(F.lit(EXCERPT_LEAST), F.least(F.lit(EXCERPT_MOST), F.col("__half"))))
        cut = F.when(F.size(lines) == 1, outline).otherwise(F.concat(F.lit("# focused excerpt\n"), F.array_join(F.transform(lines, lambda i: F.get(F.split("source", "\n"), i)), "\n")))
        long = (F.col("role") == "task-anchor") & (F.octet_length("source") > F.greatest(F.lit(EXCERPT_FROM), F.col("__half")))
        full = F.when(long, cut).otherwise(full)
    out = _as_blocks(out.withColumn("body", text.rstrip(of_detail(full, outline))))
    return out.withColumn("terms", text.distinct_terms(F.col("body"))).drop("source", "head", "__asked", "__half")


def _as_blocks(df: DataFrame) -> DataFrame:
    """Candidates that have a body, with the block that holds it and the block's bytes."""
    block = F.concat(F.lit("\n# "), "role", F.lit(": "), "id", F.lit("\n"), "body", F.lit("\n"))
    return df.withColumn("block", block).withColumn("bytes", F.octet_length("block"))


def _gathered(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """A task's candidates (a few hundred at most, by the retrieval limits) as one array; rows are exchanged before they are
    gathered, as arrays of them take twice the room."""
    return candidates.select("task_id", *columns).repartition("task_id").groupBy("task_id").agg(F.collect_list(F.struct(*columns)).alias("c"))


def _flat(groups, names: list[str]) -> tuple[list[range], dict[str, list]]:
    """An Arrow column of arrays of structs: each row's places in the flat lists of the named fields that it has (of arrays, sets of
    numbers that stand for their values in this batch).

    Nested rows cost far more to turn into Python's objects one by one than flat columns do."""
    def places(column) -> list[range]:
        ends = [0, *accumulate(n or 0 for n in plain(column.value_lengths()))]
        return [range(a, b) for a, b in pairwise(ends)]

    def plain(column) -> list:
        return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def values(column) -> list:
        if not hasattr(column, "value_lengths"):
            return plain(column)
        numbers = plain(column.flatten().dictionary_encode().indices)
        return [frozenset(numbers[r.start : r.stop]) if ok else None for r, ok in zip(places(column), plain(column.is_valid()), strict=True)]

    items = groups.flatten()
    return places(groups), {f.name: values(c) for f, c in zip(items.type, items.flatten(), strict=True) if f.name in names}


def overlap(terms: frozenset | None, chosen: list[frozenset]) -> float:
    """The greatest part that terms share with one of those already chosen."""
    most = 0.0
    for c in chosen if terms else ():
        both = len(terms & c)
        if both:
            most = max(most, both / (len(terms) + len(c) - both))
    return most


def marginal(score: float, size: int, cost: int, shared_part: float) -> float:
    """Value a byte: less the more the terms overlap those already chosen, and the longer the block is."""
    return (score - OVERLAP_PENALTY * shared_part) * max(NOVELTY_FLOOR, 1 - shared_part) / max(1, size + cost)


def greedy(candidates: DataFrame, budget: int | None, count=None) -> DataFrame:
    """Pick by marginal value until nothing is left: (task_id, id, place, state, value) with state included, omitted,
    pruned or reused.

    Input columns: task_id, id, score, role, bytes, terms, required (boolean), known (boolean), and without a common budget
    each task's own (budget).  A candidate is worth
    less the more its terms overlap one already chosen, and less the longer it is.  With ``count`` (a text's length in other
    units, tokens say) the budget is one of these units for the text packed so far and the block together, as
    units of parts need not add up; then the column block is read as well.  Each choice depends on all
    earlier ones, so a task's candidates are packed by one call; many tasks share an Arrow batch.
    """
    import pyarrow as pa

    def pack(rows: range, ids, scores, roles, sizes, terms, required, known, budgets, blocks) -> list[tuple[str, str, float]]:
        left = list({ids[i]: i for i in rows}.values())
        need = {i: 2 if roles[i] == "task-anchor" else 1 if required[i] else 0 for i in left}
        cost = {i: ROLE_COST.get(roles[i], 120) for i in left}
        met = dict.fromkeys(left, 0.0)  # the greatest overlap so far; a choice can only raise it
        values = {i: marginal(scores[i], sizes[i], cost[i], 0.0) for i in left}
        places = {i: (need[i], values[i], scores[i], ids[i]) for i in left}
        used, out, whole, limit = 0, [], "", budgets[rows[0]] if budget is None else budget
        while left:
            low = {i for i in left if values[i] < VALUE_FLOOR and not need[i]}
            if low:
                out += [(ids[i], "pruned", values[i]) for i in left if i in low]
                left = [i for i in left if i not in low]
            if not left:
                break
            i = max(left, key=places.__getitem__)
            left.remove(i)
            fits = used + sizes[i] <= limit if count is None else count(whole + blocks[i]) <= limit
            if known[i] or fits:
                own = terms[i] or frozenset()
                for j in left if own else ():
                    other = terms[j] or frozenset()
                    both = len(other & own)
                    shared_part = both / (len(other) + len(own) - both)
                    if shared_part > met[j]:
                        met[j] = shared_part
                        values[j] = marginal(scores[j], sizes[j], cost[j], shared_part)
                        places[j] = (need[j], values[j], scores[j], ids[j])
                used += 0 if known[i] else sizes[i]
                whole += "" if known[i] or count is None else blocks[i]
            out.append((ids[i], "reused" if known[i] else "included" if fits else "omitted", values[i]))
        return out

    def run(batches):
        for b in batches:
            names = ["id", "score", "role", "bytes", "terms", "required", "known", "budget", "block"]
            places, c = _flat(b.column(1), names)
            fields = [c.get(f) for f in names]
            tasks, out = b.column(0), [pack(rows, *fields) for rows in places]
            at = pa.array([i for i, rows in enumerate(out) for _ in rows], pa.int64())
            flat = [(place, *row) for rows in out for place, row in enumerate(rows)]
            columns = [pa.array([r[1] for r in flat], pa.string()), pa.array([r[0] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.string()), pa.array([round(r[3], 3) for r in flat], pa.float64())]
            yield pa.RecordBatch.from_arrays([tasks.take(at), *columns], ["task_id", "id", "place", "state", "value"])

    kind = candidates.schema["task_id"].dataType.simpleString()
    gathered = _gathered(candidates, ["id", "score", "role", "bytes", "terms", "required", "known", *(["budget"] if budget is None else []), *(["block"] if count else [])])
    return gathered.mapInArrow(run, f"task_id {kind}, id string, place int, state string, value double")


def measured(blocks: DataFrame, count, column: str = "bytes") -> DataFrame:
    """Blocks with their own size in the caller's units: ``count`` takes a text and gives a whole number (tokens of a
    tokenizer, say).  Where such sizes do not add up, give ``count`` to ``greedy`` instead.  Texts are counted in Arrow
    batches."""
    @F.pandas_udf("int")
    def units(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: int(count(t or "")))

    return blocks.withColumn(column, units("block"))


def frontier(candidates: DataFrame, budget: int) -> DataFrame:
    """Pack an edit's surroundings (task_id, id, role, ord, bytes, terms, used) role by role; the first of each role is
    required, the others are pruned below the value floor; blocks that do not fit are passed over.

    A fold over the ordered candidates: its state is the bytes used, the roles met and the terms chosen so far.
    """
    import pyarrow as pa

    place = F.array_position(F.array(*map(F.lit, FRONTIER_BASE)), F.col("role"))
    item = F.struct(place.alias("place"), "ord", "id", "role", F.col("bytes").cast("long").alias("bytes"), F.array_distinct("terms").alias("terms"), F.col("used").cast("long").alias("used"))
    own = candidates.where(F.col("role").isin(list(FRONTIER_BASE))).select("task_id", item.alias("c"))
    rows = own.groupBy("task_id").agg(F.array_sort(F.collect_list("c")).alias("c"))

    def fold(rows: range, roles, sizes, terms, used) -> list[str]:
        total, met, chosen, out = used[rows[0]], set(), [], []
        for i in rows:
            role, size = roles[i], sizes[i]
            if size is not None and role in met and marginal(FRONTIER_BASE[role], size, FRONTIER_COST[role], overlap(terms[i], chosen)) < VALUE_FLOOR:
                state = "pruned"
            elif size is None or total is None or total + size > budget:
                state = "omitted"
            else:
                state, total = "included", total + size
                met.add(role)
                if terms[i]:
                    chosen.append(terms[i])
            out.append(state)
        return out

    def run(batches):
        names = ["role", "bytes", "terms", "used"]
        for b in batches:
            places, c = _flat(b.column(1), names)
            states = pa.array([x for rows in places for x in fold(rows, *(c[f] for f in names))], pa.string())
            at = pa.array([i for i, rows in enumerate(places) for _ in rows], pa.int64())
            items = b.column(1).flatten()
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(items.field(f) for f in ("id", "role")), states], ["task_id", "id", "role", "state"])

    kind = candidates.schema["task_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"task_id {kind}, id string, role string, state string")


def imports_block(used: DataFrame, imports: DataFrame, budget: int) -> DataFrame:
    """(task_id, block, bytes, included): a task's imports, each once in their order, as the last block of its pack; it is
    added whole or not at all.  ``used``: (task_id, used); ``imports``: (task_id, source, ord)."""
    firsts = imports.groupBy("task_id", "source").agg(F.min("ord").alias("ord"))
    lines = firsts.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x.source), "\n").alias("lines"))
    out = used.join(lines, "task_id").withColumn("block", F.concat(F.lit("\n# imports\n"), "lines", F.lit("\n"))).withColumn("bytes", F.octet_length("block"))
    return out.select("task_id", "block", "bytes", (F.col("used") + F.col("bytes") <= budget).alias("included"))


def receipt_ids(symbols: DataFrame) -> DataFrame:
    """(task_id, receipt): the name of the receipt of a task's symbols (task_id, id, hash), from their sorted JSON."""
    text_of = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    pair = F.struct("id", F.concat(text_of(F.col("id")), F.lit(": "), text_of(F.col("hash"))).alias("json"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set(pair)), lambda x: x.json), ", ")
    return symbols.groupBy("task_id").agg(F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 24).alias("receipt"))


def first_fit(blocks: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """(task_id, id, included): in order, every block that still fits; a block that does not is passed over."""
    key = F.struct(*order, "id", "bytes")
    rows = blocks.groupBy("task_id").agg(F.array_sort(F.collect_list(key)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,included:boolean>>").alias("out"))

    def take(s: Column, r: Column) -> Column:
        fits = s.used + r.bytes <= budget
        return F.struct((s.used + F.when(fits, r.bytes).otherwise(0)).alias("used"), F.concat(s.out, F.array(F.struct(r.id.alias("id"), fits.alias("included")))).alias("out"))

    return rows.select("task_id", F.inline(F.aggregate("rows", start, take).out))


def prefix_fit(blocks: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """(task_id, id, running, included, complete): blocks up to the first that does not fit; any omission makes the pack
    incomplete, and then no source is passed on."""
    w = Window.partitionBy("task_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("running", F.sum("bytes").over(w)).withColumn("included", F.col("running") <= budget)
    return out.withColumn("complete", F.bool_and("included").over(Window.partitionBy("task_id")))


def sufficiency(required: DataFrame, represented: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, missing, evidence_state) from required and represented (task_id, id)."""
    missing = required.join(represented, ["task_id", "id"], "left_anti").groupBy("task_id").agg(F.array_sort(F.collect_set("id")).alias("missing"))
    out = tasks.select("task_id").distinct().join(missing, "task_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return out.withColumn("evidence_state", F.when(F.size("missing") == 0, "sufficient").otherwise("blocked-partial"))


def split_receipt(selected: DataFrame, receipt: DataFrame) -> DataFrame:
    """Selected (task_id, id, hash) with whether a receipt shows that this very content was delivered before."""
    known = receipt.select("id", "hash").distinct().withColumn("reused", F.lit(True))
    return selected.join(known, ["id", "hash"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def route(df: DataFrame) -> DataFrame:
    """Cost of the engine's pack against plain reads, both in bytes, and whether to use the pack.

    Input: source_bytes, native_reads, n_paths, source_count, evidence_bytes, sufficient, intent.
    """
    reads = F.greatest(F.lit(1), F.col("native_reads"), F.col("n_paths"))
    reads = F.when(F.col("intent") == "edit", F.greatest(F.lit(3), reads)).otherwise(reads)
    native = F.col("source_bytes") + reads * READ_COST + SEARCH_COST + F.least(F.lit(FILE_CAP), F.col("source_count") * FILE_COST)
    followup = F.when(F.col("sufficient"), 0).otherwise(F.greatest(F.lit(FOLLOWUP), F.expr("evidence_bytes div 2")))
    engine = F.col("evidence_bytes") + ENVELOPE + followup
    out = df.withColumn("expected_native_units", native.cast("long")).withColumn("expected_followup_units", followup.cast("long")).withColumn("expected_engine_units", engine.cast("long"))
    saving = 1.0 - F.col("expected_engine_units") / F.greatest(F.lit(1), F.col("expected_native_units"))
    return out.withColumn("expected_saving", F.round(saving, 4)).withColumn("activate", F.col("sufficient") & (saving >= MARGIN))


def effective_route(df: DataFrame) -> DataFrame:
    """Cost of the action taken: context_chars, plus all native reads where those are still needed."""
    native = F.col("expected_native_units")
    follow = F.when(F.col("requires_native"), native).otherwise(0)
    engine = F.col("context_chars") + follow
    return df.select("*", engine.cast("long").alias("effective_units"), follow.cast("long").alias("effective_followup"), F.when(native != 0, F.round(1.0 - engine / native, 4)).otherwise(0.0).alias("effective_saving"))


def footer(df: DataFrame, template: str = "estimated_token_saving_percent: {}\n", rounds: int = 5) -> DataFrame:
    """The printed percentage counts the footer that prints it; a few rounds reach the fixed point, as in
    ``payload_chars``, ``expected_native_units`` -> ``percent``."""
    extra = len(template.format(""))

    def percent(chars: Column) -> Column:
        return F.round(F.least(F.lit(1.0), F.round(1.0 - chars / F.nullif(F.col("expected_native_units").cast("double"), F.lit(0.0)), 4)) * 100, 1)

    value = percent(F.col("payload_chars"))
    for _ in range(rounds):
        value = percent(F.col("payload_chars") + extra + F.length(F.format_string("%.1f", value)))
    return df.withColumn("percent", F.when((F.col("expected_native_units") > 0) & (value >= 0), value))


def decide(df: DataFrame, payload_limit: int = 7800) -> DataFrame:
    """Reason, activation and evidence state of each task, the first reason that applies.

    Input: failed, valid_repository, is_code, source_count, has_evidence, sufficient, activate, complete, payload_chars.
    """
    reason = (
        F.when(F.col("failed"), "internal_error").when(~F.col("valid_repository"), "invalid_repository").when(~F.col("is_code"), "non_code_task")
        .when(F.col("source_count") == 0, "empty_repository").when(~F.col("has_evidence"), "no_evidence").when(~F.col("sufficient"), "blocked_partial")
        .when(~F.col("activate"), "low_expected_saving").when(~F.col("complete"), "atomic_budget_exhausted")
        .when(F.col("payload_chars") > payload_limit, "payload_limit").otherwise("evidence_complete")
    )
    out = df.withColumn("reason", reason)
    activation = F.when(F.col("reason") == "evidence_complete", "enabled").when(F.col("reason") == "internal_error", "failed").otherwise("skipped")
    state = F.when(F.col("reason") == "evidence_complete", "sufficient").when(F.col("reason").isin("blocked_partial", "atomic_budget_exhausted", "payload_limit"), "blocked-partial").otherwise("unavailable")
    return out.withColumn("activation", activation).withColumn("evidence_state", state)


def shape(df: DataFrame) -> DataFrame:
    """Whether to answer with the whole file: one anchor, a reading intent, one file, nothing omitted or reused, within
    the budget and shorter than the compact answer."""
    bypass = (F.col("anchors") == 1) & F.col("intent").isin("minimal", "understand") & (F.col("paths") == 1) & (F.col("omitted") == 0) & (F.col("reused") == 0) & (F.col("file_bytes") <= F.col("budget")) & (F.col("file_response_bytes") < F.col("compact_bytes"))
    return df.withColumn("delivery", F.when(bypass, "full-file-cost-bypass").otherwise("symbol-pack"))


def resolve_query(found: DataFrame) -> DataFrame:
    """One symbol a query: the only one of that very name, or else the only hit; (query, id, ready)."""
    exact = F.lower("name") == F.lower("query")
    g = found.groupBy("query").agg(F.count("*").alias("n"), F.sum(exact.cast("int")).alias("n_exact"), F.min(F.when(exact, F.col("id"))).alias("exact_id"), F.min("id").alias("any_id"))
    chosen = F.when(F.col("n_exact") == 1, F.col("exact_id")).when(F.col("n") == 1, F.col("any_id"))
    return g.select("query", chosen.alias("id"), chosen.isNotNull().alias("ready"))
