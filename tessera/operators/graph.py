"""Joins over symbols and edges: name resolution, overlays, relations, transitive impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from . import shared


def confidence_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in schemas.CONFIDENCE.items() for x in kv))[c], F.lit(9))


# ---- resolution of names

def resolve_scope(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Undotted names: the symbol of that name in the nearest enclosing scope of the same file."""
    scope = symbols.select(F.col("id").alias("source"), F.split("qualname", r"\.").alias("scope"))
    plain = edges.where(~F.col("name").contains(".")).select("source", "path", "name", "line").distinct()
    tried = plain.join(scope, "source", "left").withColumn("depth", F.explode(F.sequence(F.coalesce(F.size("scope"), F.lit(0)), F.lit(0))))
    prefix = F.when(F.col("depth") > 0, F.concat(F.array_join(F.slice("scope", 1, F.greatest("depth", F.lit(1))), "."), F.lit("."))).otherwise("")
    keyed = tried.withColumn("target", F.concat("path", F.lit("::"), prefix, "name"))
    found = keyed.join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
    return shared.top(found, ["source", "path", "name", "line"], [F.desc("depth")], 1).select("source", "path", "name", "line", "target")


def resolve_self(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names on self or cls: the member of the class that the scope's symbol belongs to."""
    on_self = edges.where(F.col("name").rlike(r"^(self|cls)\.")).select("source", "path", "name", "line").distinct()
    scope = symbols.select(F.col("id").alias("source"), F.col("parent").alias("cls"))
    classes = symbols.where(F.col("kind") == "class").select(F.col("id").alias("cls"))
    member = on_self.join(scope, "source").join(classes, "cls").withColumn("target", F.concat("cls", F.lit("."), F.regexp_replace("name", r"^(self|cls)\.", "")))
    return member.join(symbols.select(F.col("id").alias("target")), "target", "left_semi").select("source", "path", "name", "line", "target")


def resolve_imports(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imported dotted names (``imported``): the one symbol of that full name, else the one whose full name ends in it.

    Suffixes of full names are exploded, so that the match is an equi-join; only single candidates are taken.
    """
    full = symbols.select(F.col("id").alias("target"), F.col("full").alias("key"))
    wanted = names.select("imported").distinct()
    whole = wanted.join(full, F.col("imported") == F.col("key")).groupBy("imported").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    parts = F.split("key", r"\.")
    ends = full.withColumn("from", F.explode(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))))).where(F.col("from") <= F.size(parts))
    ends = ends.withColumn("end", F.array_join(F.slice(parts, F.col("from"), F.size(parts)), "."))
    rest = wanted.join(whole, "imported", "left_anti")
    tails = rest.join(ends, F.col("imported") == F.col("end")).groupBy("imported").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    return whole.unionByName(tails).where("n = 1").select("imported", "target")


def resolve(edges: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """All edges with target and confidence: scope, then self, then imports (``path, alias, imported``)."""
    near = resolve_scope(edges, symbols).unionByName(resolve_self(edges, symbols)).withColumnRenamed("target", "near")
    head, tail = F.substring_index("name", ".", 1), F.regexp_extract("name", r"^[^.]*(.*)$", 1)
    last = shared.top(imports, ["path", "alias"], [F.desc("line"), F.desc("ord")], 1).select("path", "alias", F.col("imported").alias("module"))
    via = edges.withColumn("alias", head).join(last, ["path", "alias"]).select("path", "name", F.concat("module", tail).alias("imported")).distinct()
    found = via.join(resolve_imports(via, symbols), "imported").select("path", "name", F.col("target").alias("far"))
    out = edges.drop("target", "confidence").join(near, ["source", "path", "name", "line"], "left").join(found, ["path", "name"], "left")
    target = F.coalesce("near", "far")
    return out.withColumn("target", target).withColumn("confidence", F.when(target.isNull(), "unresolved").otherwise("static_candidate")).drop("near", "far")


# ---- overlays

def validate_overlay(overlay: DataFrame, symbols: DataFrame) -> DataFrame:
    """Overlay edges with the first reason to reject them, null for valid ones."""
    known = symbols.select("id").distinct()
    has = lambda side: known.select(F.col("id").alias(side), F.lit(True).alias(f"has_{side}"))
    out = overlay.join(has("source"), "source", "left").join(has("target"), "target", "left")
    endpoint = F.col("has_source").isNull() | F.col("has_target").isNull()
    reason = (
        F.when(endpoint, "endpoint").when(~F.col("kind").isin(*schemas.OVERLAY_KINDS), "kind")
        .when(~F.col("confidence").isin("semantic_exact", "semantic_inferred"), "confidence").when(F.col("line") < 1, "line")
    )
    return out.withColumn("reason", reason).drop("has_source", "has_target")


def dedupe_overlay(overlay: DataFrame) -> DataFrame:
    """One edge for each source, target and kind: the last exact one, else the first; ``ord`` is the given order."""
    exact = (F.col("confidence") == "semantic_exact").cast("int")
    place = F.when(exact == 1, -F.col("ord")).otherwise(F.col("ord"))
    return shared.top(overlay, ["source", "target", "kind"], [exact.desc(), place], 1).drop("rank")


def merge(static: DataFrame, semantic: DataFrame) -> DataFrame:
    """Semantic edges, and the static ones that they do not restate; null targets compare as equal."""
    s, t = static.alias("s"), semantic.select("source", "target", "kind").distinct().alias("t")
    same = reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("source", "target", "kind")))
    kept = s.join(t, same, "left_anti")
    return semantic.unionByName(kept, allowMissingColumns=True).withColumn("confidence_rank", confidence_rank(F.col("confidence")))


def order() -> list[Column]:
    return [F.col("confidence_rank"), F.col("source"), F.coalesce("target", F.lit("")), F.col("kind"), F.col("line")]


def overlay_state(active: Column, current: Column) -> Column:
    return F.when(active.isNull(), "absent").when(active == current, "active").otherwise("stale")


# ---- relations

def relations(edges: DataFrame, ids: DataFrame, direction: str, kind: str | None = None, limit: int = 50, unresolved: bool = True) -> DataFrame:
    """For each id its edges in one direction, at most ``limit`` in the order of ``merge``, with total and truncated."""
    shared.require(1 <= limit <= 200, "limit must be between 1 and 200")
    key = "source" if direction == "out" else "target"
    if "confidence_rank" not in edges.columns:
        edges = edges.withColumn("confidence_rank", confidence_rank(F.col("confidence")))
    if kind is not None:
        edges = edges.where(F.col("kind") == kind)
    if not unresolved:
        edges = edges.where("target is not null")
    hit = edges.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").withColumn("id", F.col(key))
    counts = hit.groupBy("id").agg(F.count("*").alias("total"))
    first = shared.top(hit, ["id"], order(), limit)
    return first.join(counts, "id").withColumn("truncated", F.col("total") > limit)


def refs(edges, ids, limit=50):
    return relations(edges, ids, "in", "reference", limit)


def callers(edges, ids, limit=50):
    return relations(edges, ids, "in", "call", limit)


def callees(edges, ids, limit=50):
    return relations(edges, ids, "out", "call", limit)


def dependencies(edges, ids, limit=50):
    return relations(edges, ids, "out", None, limit)


def closure(edges: DataFrame, starts: DataFrame, inverse: bool = True) -> DataFrame:
    """(start, id): everything that reaches a start over resolved edges (or is reached), the start included.

    Rounds expand the newest frontier only; seen pairs are taken away by an anti-join, so cycles end.  Each round's
    frontier is written, so that lineage stays short and a lost executor repeats one round.  Every round reads all arcs, so
    they are sifted by a number made of their end before texts are compared; arcs that repeat are not made distinct, as steps are.
    """
    a, b = ("target", "source") if inverse else ("source", "target")
    arcs = shared.written(edges.where("target is not null").select(F.xxhash64(a).alias("mark"), F.col(a).alias("at"), F.col(b).alias("to")), "arcs")
    front = shared.written(starts.select(F.col("id").alias("start"), F.col("id").alias("id")).distinct(), "front")
    rounds = []
    while n := front.count():
        rounds.append(front)
        marks = front.select(F.xxhash64("id").alias("mark")).distinct()
        near = arcs.join(F.broadcast(marks), "mark", "left_semi") if n <= shared.BROADCAST_ROWS else arcs
        step = front.join(near, F.col("id") == F.col("at")).select("start", F.col("to").alias("id")).distinct()
        front = shared.written(step.join(reduce(DataFrame.unionByName, rounds), ["start", "id"], "left_anti"), "front")
    return reduce(DataFrame.unionByName, rounds, front)


def affected_tests(edges: DataFrame, symbols: DataFrame, starts: DataFrame) -> DataFrame:
    return closure(edges, starts).join(symbols.where("is_test").select("id", "name"), "id")


def relevant_tests(affected: DataFrame, limit: int = 2) -> DataFrame:
    """Rows (task_id, id, task_terms, test_terms, named): shared terms, 8 more where the target's name occurs; best two."""
    score = F.size(F.array_intersect("task_terms", "test_terms")) + F.when(F.col("named"), 8).otherwise(0)
    return shared.top(affected.withColumn("score", score).where("score > 0"), ["task_id"], [F.desc("score"), F.col("id")], limit)


STEM = r"([^/]*?)(?:\.[^./]*)?$"  # of a file's name


def companions(paths: DataFrame, limit: int = 2) -> DataFrame:
    """For each task's best path (score, then path): other paths with the same file stem, in order, at most two;
    without any, the next best path."""
    best = Window.partitionBy("task_id").orderBy(F.desc("score"), F.desc("path"))
    ranked = paths.withColumn("stem", F.lower(F.regexp_extract("path", STEM, 1))).withColumn("place", F.row_number().over(best))
    lead = ranked.where("place = 1").select("task_id", F.col("path").alias("best"), F.col("stem").alias("best_stem"))
    others = ranked.where("place > 1").join(lead, "task_id")
    kin = shared.top(others.where(F.col("stem") == F.col("best_stem")), ["task_id"], [F.col("path")], limit)
    alone = others.join(kin.select("task_id").distinct(), "task_id", "left_anti")
    following = shared.top(alone, ["task_id"], [F.desc("score"), F.col("path")], 1)
    return kin.select("task_id", "best", "path").unionByName(following.select("task_id", "best", "path"))


def locate(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Range join: the symbol of the probe's path whose lines hold the probe's line; a name match first, then the
    smallest span, then the id."""
    s = symbols.select("id", "path", F.col("name").alias("s_name"), "start", "end")
    hit = probes.join(s, "path").where((F.col("start") <= F.col("line")) & (F.col("line") <= F.col("end")))
    return shared.top(hit, ["probe_id"], [F.desc(F.col("s_name") == F.col("name")), F.col("end") - F.col("start"), F.col("id")], 1)


def outermost(items: DataFrame) -> DataFrame:
    """Ids that do not lie inside another id of the same task (``id`` does not start with the other and a dot)."""
    parts = F.split("id", r"\.")
    inside = items.select("task_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("outer")).where("outer <> id")
    held = inside.join(items.select("task_id", F.col("id").alias("outer")), ["task_id", "outer"], "left_semi").select("task_id", "id").distinct()
    return items.join(held, ["task_id", "id"], "left_anti")
