"""Comparison of answers with what was expected, by rule or rubric, and small extractions from sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

RULES = ("exact", "number_sequence", "numeric_sequence", "labeled_sequence", "path_categories", "ast_type_sequence")
# The words of each category, any of which will do.
PATH_CATEGORIES = [["absolute", "绝对路径"], ["internal", "内部状态"], ["symlink", "符号链接"]]
# Words of a task that asks for a number of things.
COUNT_WORDS = ["how many", "count", "多少", "几个", "几项"]
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def squeezed(text: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def semantic_match(rule: Column, expected: Column, observed: Column) -> Column:
    """Whether an answer is right under its task's rule (an unknown rule is ``exact``); false without an answer."""
    numbers = lambda c: F.transform(_all(c, r"-?\d+(?:\.\d+)?"), lambda x: x.cast("double"))
    values = lambda c: F.transform(F.split(c, r"\|"), lambda x: F.trim(F.substring_index(x, "=", -1)))
    types = lambda c: F.replace(F.replace(F.lower(c), F.lit("ast."), F.lit("")), F.lit(" "), F.lit(""))
    named = F.lit(True)
    for words in PATH_CATEGORIES:
        some = F.lit(False)
        for w in words:
            some = some | F.lower(observed).contains(w)
        named = named & some
    same = (
        F.when(rule == "number_sequence", _all(observed, r"\d+") == _all(expected, r"\d+")).when(rule == "numeric_sequence", numbers(observed) == numbers(expected))
        .when(rule == "labeled_sequence", values(observed) == values(expected)).when(rule == "path_categories", named)
        .when(rule == "ast_type_sequence", types(observed) == types(expected)).otherwise(observed == expected)
    )
    return F.coalesce(same, F.lit(False))


def read_answer(final: Column) -> Column:
    """What stands between the answer marks if the whole reply is one marked answer; null otherwise."""
    marked = r"(?s)^\s*<answer>(.*?)</answer>\s*$"
    out = F.trim(F.regexp_extract(final, marked, 1))
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(final.rlike(marked), out)


def rubric_match(observed: Column, rubric: Column, whole: Column, expected: Column) -> Column:
    """Without a rubric the squeezed texts must be equal; ``whole`` rubrics find all their patterns in the answer, others
    one in each of its parts between bars."""
    text = squeezed(observed)
    parts = F.when(F.size(rubric) == 1, F.array(text)).otherwise(F.transform(F.split(observed, r"\|"), squeezed))
    fits = lambda c, p: F.regexp_like(c, F.concat(F.lit("(?i)"), p))
    by_part = (F.size(parts) == F.size(rubric)) & F.forall(F.zip_with(parts, rubric, lambda c, p: F.coalesce(fits(c, p), F.lit(False))), lambda x: x)
    none = rubric.isNull() | (F.size(rubric) == 0)
    return F.coalesce(F.when(none, text == squeezed(expected)).when(whole, F.forall(rubric, lambda p: fits(text, p))).otherwise(by_part), F.lit(False))


def normalized_return(source: Column, name: Column) -> Column:
    """The expression that a function without parameters returns in its first line, blanks squeezed; null if there is none."""
    head = F.concat(F.lit("def "), name, F.lit("():"))
    # the first place of the head that a return follows: the text is cut at heads, so the name is never read as a pattern
    after = F.filter(F.slice(F.split(source, F.concat(F.lit(r"\Q"), head, F.lit(r"\E"))), 2, 1 << 20), lambda x: x.rlike(r"^\s*\r?\n\s*return ."))
    return F.trim(F.regexp_replace(F.regexp_extract(F.get(after, 0), r"^\s*\r?\n\s*return (.+)", 1), r"\s+", " "))


def derived_facts(tasks: DataFrame, anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, fact): sizes of literal collections of the anchors that a counting task names, each once."""
    folded = F.lower("text")
    asks = F.lit(False)
    for w in COUNT_WORDS:
        asks = asks | folded.contains(w)
    sizes = symbols.where("language = 'python'").select("id", F.explode("literals").alias("name", "size"))
    met = tasks.where(asks).select("task_id", folded.alias("folded")).join(anchors.select("task_id", "id"), "task_id").join(sizes, "id")
    fact = F.concat("name", F.lit(" cardinality = "), F.col("size").cast("string"))
    return met.where(F.col("folded").contains(F.lower("name"))).select("task_id", fact.alias("fact")).distinct()


def control_flow_hints(tasks: DataFrame, anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(task_id, id, hint): for tasks (task_id, text) that ask about failures, what runs in an anchor (task_id, id) before its
    first handler and so is not covered by it.  A null text asks nothing; an anchor given twice gives one row."""
    asked = tasks.where(text.asks_about_failure(F.col("text"))).select("task_id").distinct()
    open_ = symbols.where("exposed is not null").select("id", "language", "exposed.first", "exposed.last")
    lines = F.format_string("%s lines %d-%d run before its try; what they raise does not reach its handlers", "id", "first", "last")
    near = F.format_string("%s has statements before the try block near line %d; what they throw does not reach its catch", "id", "first")
    found = anchors.select("task_id", "id").distinct().join(asked, "task_id").join(open_, "id")
    return found.select("task_id", "id", F.when(F.col("language") == "python", lines).otherwise(near).alias("hint"))
