"""Token counts by a compiled transducer.

A byte-level BPE tokenizer is compiled, lazily and per worker, into a deterministic transducer over characters.
A state holds where the pre-tokenizer stands and, for the open piece, every start from which a token could still
grow, with the last token before that start.  A transition carries the number of tokens that the character adds
to the count of the text read so far (it may be negative when a longer token replaces shorter ones), so a count
is the sum along the path.  A chunk whose entry state is unknown is summarised as a map from entry states to
(count, exit state): at a place where a piece ends whatever came before (a blank behind a non-blank, or a change between
letters, digits and signs) every entry state leads to the same state, so the map is (head, settled count, tail).
Maps compose associatively, in a balanced scan.  Only a chunk within one run of letters, digits, signs or blanks has no
such place; the run is one piece, which the tokenizer itself treats as a whole, and joins the next chunk.  For the same
reason a space and the word behind it lead from a settled place to the next one: such steps are kept as composite
transitions, so that a frequent word is one step and not one for each character.

A file that asks for more than this (a normalizer, another pre-tokenizer, dropout, added tokens that strip or match
whole words) is refused.  Null and empty texts have 0 tokens.  Special strings inside a text count as one token each, as the library does.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 16_384  # characters of a chunk
SPREAD = 65_536  # characters beyond which a text's chunks are dealt out to many tasks
MAX_TRANSITIONS = 800_000  # of a worker's table (some 300 bytes each); beyond it the lazily built table starts anew
MAX_WORDS = 600_000  # composite transitions of a worker's table, likewise
_BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(x) for x in range(0x2000, 0x200B)}
LONGEST = 32  # characters of a word whose count is remembered
_machines: dict[str, "Transducer"] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _State(dict):
    """Character -> (next state, tokens added); missing entries are compiled on first use."""

    __slots__ = ("owner", "mode", "core", "extra")

    def __init__(self, owner, mode, core, extra):
        self.owner, self.mode, self.core, self.extra = owner, mode, core, extra

    def __missing__(self, ch):
        hit = self[ch] = self.owner._compile(self, ch)
        self.owner.made += 1
        return hit


def _pack(live: list[tuple[int, int, int]]) -> bytes:
    """Open starts (trie node, last token before, tokens before), oldest first."""
    return array("q", [node << 40 | last + 1 << 20 | n + (1 << 19) for node, last, n in live]).tobytes()


def _unpack(core: bytes) -> list[tuple[int, int, int]]:
    return [(x >> 40, (x >> 20 & 0xFFFFF) - 1, (x & 0xFFFFF) - (1 << 19)) for x in array("q", core)]


class ChunkMap(NamedTuple):
    """What a chunk does to any entry state; head is None-free, settled is -1 if no place settles the state."""

    head: str
    settled: int
    tail: str


def _checked(spec: dict) -> dict:
    """The tokenizer's file, if all that it asks for is modelled here."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    pieces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = all(not t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
    if not (plain and pieces and added and not spec.get("normalizer")):
        raise ValueError("this tokenizer is not modelled: byte-level BPE without a normalizer and with plain added tokens is")
    return spec


class Transducer:
    def __init__(self, path: str):
        spec = _checked(json.load(open(path, encoding="utf-8")))
        alphabet = _byte_alphabet()
        number = {s: b for s, b in alphabet.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(b, -1) for b in range(256)]
        spelled: list[bytes] = [bytes([b]) for b in range(256)]
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = number[left], number[right]
            number[left + right] = self.pair[a, b] = 256 + rank
            self.parts.append((a, b))
            spelled.append(spelled[a] + spelled[b])
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for k, word in enumerate(spelled):
            node = 0
            for b in word:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = k
        self._kind: dict[str, str] = {}
        self._spec = path
        self._library = None
        self._reset()

    def _reset(self) -> None:
        self.made = 0
        self.fits: dict[int, bool] = {}
        self.words: dict[str, int] = {}  # tokens from a settled place over a space and this word
        self.states: dict = {}
        self.firsts: dict[str, tuple[bytes, int]] = {}
        self.empty = _pack([(0, -1, 0)])
        self.start = self._state("", b"", "")

    def _state(self, mode, core, extra) -> _State:
        key = f"{mode}\0{extra}".encode("utf-8", "surrogatepass") + core
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = _State(self, mode, core, extra)
        return got

    # which two neighbouring tokens can stand next to each other in an encoding
    def _adjacent(self, a: int, b: int) -> bool:
        """No merge across the seam would have come before the merges that made both tokens."""
        known = self.fits.get(a << 20 | b)
        if known is None:
            left, right, bar = a, b, 1 << 60
            while True:
                if self.pair.get((left, right), bar) < bar:
                    known = False
                    break
                if left < 256 and right < 256:
                    known = True
                    break
                # undo the later of the two tokens: it was made after the other one stood complete
                if left > right:
                    bar, left = left, self.parts[left][1]
                else:
                    bar, right = right + 1, self.parts[right][0]
            self.fits[a << 20 | b] = known
        return known

    def _bytes(self, core: bytes, data: bytes) -> tuple[bytes, int]:
        """Some bytes of an open piece: the next core and what they add to the count."""
        live, added, trie, token_at = _unpack(core), 0, self.trie, self.token
        for b in data:
            grown, found = [], None
            for node, last, n in live:
                nxt = trie[node].get(b)
                if nxt is None:
                    continue
                token = token_at[nxt]
                if found is None and token >= 0 and (last < 0 or self._adjacent(last, token)):
                    found = token, n + 1
                if trie[nxt]:
                    grown.append((nxt, last, n))
            token, total = found
            live = [(node, last, n - total) for node, last, n in grown]
            live.append((0, token, 0))
            added += total
        return _pack(live), added

    def _step(self, core: bytes, ch: str) -> tuple[bytes, int]:
        if core is not self.empty:
            return self._bytes(core, ch.encode("utf-8", "surrogatepass"))
        got = self.firsts.get(ch)
        if got is None:
            got = self.firsts[ch] = self._bytes(core, ch.encode("utf-8", "surrogatepass"))
        return got

    def _run(self, text: str) -> tuple[bytes, int]:
        return self._bytes(self.empty, text.encode("utf-8", "surrogatepass"))

    def kind(self, ch: str) -> str:
        """L letter, N number, W blank, P anything else, as the library's own pre-tokenizer sees it."""
        got = self._kind.get(ch)
        if got is None:
            if ch in _BLANKS:
                got = "W"
            elif ch.isascii():
                got = "L" if ch.isalpha() else "N" if ch.isdigit() else "P"
            else:
                if self._library is None:
                    from tokenizers import Tokenizer

                    self._library = Tokenizer.from_file(self._spec).pre_tokenizer
                one = lambda lead: len(self._library.pre_tokenize_str(lead + ch)) == 1
                got = "L" if one("a") else "N" if one("1") else "P" if one("!") else "W"
            self._kind[ch] = got
        return got

    def _open(self, ch: str):
        kind = self.kind(ch)
        core, n = self._step(self.empty, ch)
        if kind == "W":
            return self._state("W", self.empty, ch), n
        return self._state("'" if ch == "'" else kind, core, ""), n

    def _compile(self, at: _State, ch: str):
        mode, core = at.mode, at.core
        if mode == "":
            return self._open(ch)
        kind = self.kind(ch)
        if mode == "W":
            before, n_last = self._step(core, at.extra)
            if kind == "W":
                return self._state("W", before, ch), self._step(before, ch)[1]
            if at.extra == " ":
                piece, n = self._run(" " + ch)
                return self._state(kind, piece, ""), n - n_last
            nxt, n = self._open(ch)
            return nxt, n + self._step(self.empty, at.extra)[1] - n_last
        if mode == "'":
            if ch in "stmd":
                return self.start, self._run("'" + ch)[1] - self._run("'")[1]
            if ch in "rvl":
                piece, n = self._step(self.empty, ch)
                return self._state("'" + ch, piece, ""), n
            mode = "P"
        if mode in ("'r", "'v", "'l"):
            if ch == ("l" if mode == "'l" else "e"):
                return self.start, self._run(mode + ch)[1] - self._run("'")[1] - self._run(mode[1])[1]
            mode = "L"
        if kind == mode:
            piece, n = self._step(core, ch)
            return self._state(mode, piece, ""), n
        return self._open(ch)

    def _walk(self, text: str) -> int:
        state, total = self.start, 0
        for ch in text:
            state, n = state[ch]
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text without special strings that starts and ends at certain piece boundaries."""
        if self.made > MAX_TRANSITIONS:
            self._reset()
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known, total = self.words, 0
        words = text.split(" ")
        open_run = words[0]  # blanks not yet behind a word, or a text's first word
        if open_run and not open_run[-1].isspace():
            total, open_run = self._walk(open_run), None
        for w in words[1:]:
            if open_run is None:
                n = known.get(w)
                if n is not None:
                    total += n
                elif w and not w[-1].isspace():
                    n = self._walk(" " + w)
                    if len(w) <= LONGEST:
                        known[w] = n
                    total += n
                else:
                    open_run = " " + w
            else:
                open_run += " " + w
                if w and not w[-1].isspace():
                    total += self._walk(open_run)
                    open_run = None
        return total if open_run is None else total + self._walk(open_run)

    def _ends(self, a: str, b: str) -> bool:
        """Whether a piece ends between two characters whatever stands before them; a letter behind an apostrophe may
        belong to a contraction, and a blank may lead the word behind it."""
        left, right = self.kind(a), self.kind(b)
        return left != "W" and left != right and not (a == "'" and right == "L")

    def chunk(self, text: str) -> ChunkMap:
        f = next((i for i in range(1, len(text)) if self._ends(text[i - 1], text[i])), None)
        if f is None:
            return ChunkMap(text, -1, "")
        g = next(i for i in range(len(text) - 1, 0, -1) if self._ends(text[i - 1], text[i]))
        return ChunkMap(text[:f], self.count(text[f:g]), text[g:])

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.settled < 0:
            return ChunkMap(a.head + b.head, b.settled, b.tail)
        if b.settled < 0:
            return ChunkMap(a.head, a.settled, a.tail + b.head)
        return ChunkMap(a.head, a.settled + self.count(a.tail + b.head) + b.settled, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The composition of all maps, pairs first, in about log2(n) rounds."""
        while len(maps) > 1:
            maps = [self.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, m: ChunkMap) -> int:
        """Apply a map to the start state."""
        return self.count(m.head) + (m.settled + self.count(m.tail) if m.settled >= 0 else 0)

    def tokens(self, text: str | None, chunk: int = CHUNK) -> int:
        total = 0
        parts = re.split("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))), text or "") if self.specials else [text or ""]
        for part in parts:
            if len(part) <= chunk:
                total += self.count(part)
            else:
                total += self.finish(self.scan([self.chunk(part[i : i + chunk]) for i in range(0, len(part), chunk)]))
        return total + len(parts) - 1


def transducer(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """``id_col, n_bytes, n_tokens`` for every row of ``docs``.

    Texts up to ``spread`` characters are counted where they are read; nothing is shuffled.  The chunks of
    longer ones are dealt out, mapped in parallel, and their maps composed per text.  Repeated rows each
    give a row; an empty table gives an empty one; a null id stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    specials = [x["content"] for x in json.load(open(tokenizer, encoding="utf-8"))["added_tokens"]]
    base = docs.select(F.col(id_col).alias("id"), common.whole(text_col).alias("t")).select("id", "t", F.octet_length("t").cast("long").alias("n_bytes"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for b in batches:
            n = [machine.tokens(t, chunk) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for b in batches:
            maps = [machine.chunk(t) for t in b.column(b.schema.get_field_index("piece")).to_pylist()]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("row", "id", "n_bytes", "more", "seg", "at")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([m.head for m in maps], pa.string()), pa.array([m.settled for m in maps], pa.int64()), pa.array([m.tail for m in maps], pa.string())], ["row", "id", "n_bytes", "more", "seg", "at", "head", "settled", "tail"])

    def compose(pdf):
        import pandas as pd

        machine = transducer(tokenizer)
        total = int(pdf["more"].iloc[0])
        for _, part in pdf.sort_values(["seg", "at"]).groupby("seg", sort=False):
            total += machine.finish(machine.scan([ChunkMap(*x) for x in zip(part["head"], part["settled"], part["tail"], strict=True)]))
        return pd.DataFrame({"id": pdf["id"].iloc[:1], "n_bytes": pdf["n_bytes"].iloc[:1], "n_tokens": [total]})

    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, n_bytes long, n_tokens long"
    short = base.where(F.length("t") <= spread).mapInArrow(near, out)
    split = F.split("t", "|".join(rf"\Q{s}\E" for s in sorted(specials, key=len, reverse=True))) if specials else F.array("t")
    segs = base.where(F.length("t") > spread).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "n_bytes", split.alias("segs")).select("row", "id", "n_bytes", (F.size("segs") - 1).cast("long").alias("more"), F.posexplode("segs").alias("seg", "s"))
    # one pass cuts a text; a chunk is not sought from the text's start
    cut = F.when(F.col("s") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("s", F.lit(rf"(?s)(.{{1,{chunk}}})"), F.lit(1)))
    pieces = segs.select("row", "id", "n_bytes", "more", "seg", F.posexplode(cut).alias("at", "piece"))
    maps = pieces.repartition(F.col("row"), F.col("seg"), F.col("at")).mapInArrow(far, f"row long, id {id_type}, n_bytes long, more long, seg int, at int, head string, settled long, tail string")
    long = maps.groupBy("row").applyInPandas(compose, out)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
