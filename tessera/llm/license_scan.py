"""License scans: one Aho-Corasick pass over a text's words, then a shunting-yard parser for tagged expressions.

Words are runs of digits, letters and non-ASCII characters after A-Z are lower-cased.  Phrases match where their
words stand consecutively.  Where the words of an identifier tag stand, the expression behind the tag in the raw
text is parsed with the precedence with > and > or and evaluated to its obligation: an ``or`` takes the milder
side, an ``and`` the stricter, a ``with`` softens copyleft.  A text's score is its strictest finding.

Null and empty texts have no words, no labels (empty strings) and score 0; a tag with a broken expression counts
as ``unknown``.  A word of prose ends an expression: an identifier is a known one or has a capital, digit, hyphen, dot or
plus in it.  Null and repeated ids each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "the mit license": "mit",
    "mit licensed": "mit",
    "apache license": "apache-2",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}
# Identifiers (version and suffix removed) with their labels where the two differ.
IDENTIFIERS = {"apache": "apache-2", "0bsd": "bsd", "cc0": "public-domain", "unlicense": "public-domain"}
# Obligation of a label, 0 (none) to 1 (use forbidden); unknown labels count 0.6.
OBLIGATION = {
    "public-domain": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "apache-2": 0.25, "cc-by": 0.3, "mpl": 0.5, "lgpl": 0.5,
    "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "all-rights-reserved": 1.0,
}
TAG = "spdx license identifier"
UNKNOWN = 0.6
_W = r"0-9a-z\x80-\U0010ffff"  # characters of words
_TAG = re.compile(rf"(?<![{_W}])spdx[^{_W}]+license[^{_W}]+identifier(?![{_W}])[^0-9a-z(\n]*", re.I | re.A)
_END = re.compile(r"[\n\r]")
_TERM = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_table = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_made: list = []


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_table).split(b" ") if text else []


def _label(identifier: str) -> str:
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-[0-9.]+(-clause)?$", "", name)
    return IDENTIFIERS.get(name, name)


def _names(term: str) -> bool:
    """Whether a word is an identifier: one of the known ones, or spelled as such (a capital, digit, hyphen, dot or plus
    in it), not a word of prose behind the expression."""
    term = term.rstrip(".")
    return _label(term) in OBLIGATION or bool(re.search(r"[A-Z0-9]|[a-z][-.+]", term))


def _join(op: str, a: tuple[float, frozenset], b: tuple[float, frozenset]) -> tuple[float, frozenset]:
    if op == "with":
        return min(a[0], 0.5), a[1]
    return (min if op == "or" else max)(a[0], b[0]), a[1] | b[1]


def parse(expression: str) -> tuple[float, frozenset[str]] | None:
    """Obligation and labels of the longest well-formed expression that the text starts with; None if it has none."""
    values: list = []
    waiting: list[str] = []
    best, operand_next, depth = None, True, 0

    def reduce(least: int) -> None:
        while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= least:
            right, left = values.pop(), values.pop()
            values.append(_join(waiting.pop(), left, right))

    for term in _TERM.findall(expression):
        low = term.lower()
        if operand_next:
            if term == "(":
                waiting.append(term)
                depth += 1
                continue
            if term == ")" or low in _STRENGTH or not _names(term):
                break
            label = _label(term.rstrip("."))
            values.append((OBLIGATION.get(label, UNKNOWN), frozenset([label])))
            operand_next = False
        elif term == ")":
            if not depth:
                break
            reduce(0)
            waiting.pop()
            depth -= 1
        elif low in _STRENGTH:
            reduce(_STRENGTH[low])
            waiting.append(low)
            operand_next = True
        else:
            break
        if not operand_next and not depth:
            copy = values[:], waiting[:]
            reduce(0)
            best = values[0]
            values, waiting = copy
    return best


def _automaton():
    if not _made:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in {*BASE, *PHRASES, TAG}:
            a.add_word(f" {phrase} ", phrase)
        a.make_automaton()
        _made.append(a)
    return _made[0]


def _expressions(text: str) -> Iterator[str]:
    """What stands behind each identifier tag, up to the next tag or the end of its line."""
    tags = list(_TAG.finditer(text))
    for tag, following in zip(tags, [*(t.start() for t in tags[1:]), len(text)]):
        stop = _END.search(text, tag.end(), following)
        yield text[tag.end() : stop.start() if stop else following]


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text."""
    found = [w for w in words(text or "") if w]
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    n_base, first, last, base, labels, score, tagged = 0, None, None, set(), set(), 0.0, False
    at_end = here = 0  # blanks up to the end of the last hit: hits come in the order of their ends, so the count goes on
    for end, phrase in _automaton().iter(line):
        at_end, here = at_end + line.count(" ", here, end), end
        if phrase == TAG:
            tagged = True
            continue
        label = BASE.get(phrase) or PHRASES[phrase]
        labels.add(label)
        score = max(score, OBLIGATION.get(label, UNKNOWN))
        if phrase in BASE:
            base.add(label)
            n_base += 1
            at = at_end - phrase.count(" ") - 1
            first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    for expression in _expressions(text) if tagged else ():
        value, own = parse(expression) or (UNKNOWN, frozenset(["unknown"]))
        labels |= own
        score = max(score, value)
    return len(found), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of findings for every row of ``docs``; texts are scanned where they are read, nothing is shuffled."""
    common.bounded_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
