"""Encoding and decoding by a merge-type SentencePiece model, through a table of last tokens of prefixes.

Merging always takes the best-scored adjacent pair, the leftmost of equals, so whether two tokens can stand side by side
is settled by the two alone: they can if merging their joined text gives just them.  Hence every prefix of a text
has one last token: of the pieces that an automaton finds to end there, the one that can follow the last token of what
is before it.  The table stores it for each prefix in one pass from left to right; the ids are recovered backwards
from the end.  Time is linear in the text, whatever its length.

A text is first cut where no piece reaches across: before a blank that follows something else, and around
characters that stand in no longer piece.  What lies between two cuts is a word; a worker remembers short words' ids and tested pairs
in tables of bounded size.

Only models whose rules are written here are taken (merge type, no normalisation, dummy prefix, blanks kept, byte
fallback, no user-defined or unused pieces); others are refused.  Null and empty texts have the begin and end ids
only.  Repeated rows each give a row, null ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

SPACE = "▁"
PART = 65_536  # characters after which a text is cut at the next safe place
WORDS = 1 << 17  # words remembered by a worker
PAIRS = 1 << 19  # pairs of tokens remembered by a worker
UNKNOWN = " ⁇ "
_CUT = re.compile("(?<=[^ ▁])[ ▁]")
_loaded: dict = {}

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Words(dict):
    """Packed ids of words; short ones are remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        ids = self.model.word(word)
        if len(word) <= common.SHORT:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class Packed(dict):
    """Packed ids of tokens; a character that is no piece has those of its bytes."""

    def __init__(self, model: Model):
        super().__init__((p, model.pack(array("I", [i]))) for p, i in model.ids.items())
        self.model = model

    def __missing__(self, char: str) -> bytes:
        return self.model.pack(array("I", [self.model.bytes[b] for b in char.encode()]))


class Model:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds, norm, piece = proto.ModelProto.SentencePiece, spec.normalizer_spec, [p.piece for p in spec.pieces]
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        merge = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
        if not (plain and merge) or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("this model's rules are not modelled")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces with blanks after other characters are not modelled")
        self.ids = {p: i for i, p in enumerate(piece) if p in self.score}
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(piece) if spec.pieces[i].type == kinds.BYTE}
        self.begin, self.end = piece.index(spec.trainer_spec.bos_piece), piece.index(spec.trainer_spec.eos_piece)
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.raw = [p.replace(SPACE, " ").encode() if p in self.score else b"" for p in piece]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.raw[self.unknown] = UNKNOWN.encode()
        longer = {c for p in self.score if len(p) > 1 for c in p} - {SPACE}
        joined = "[" + "".join(map(re.escape, sorted(longer))) + "]"
        self.split = re.compile(f"{SPACE}+{joined}*|{joined}+|.", re.DOTALL)
        self.pairs: dict[tuple[str, str], bool] = {}  # tested ones
        self.words, self.packed = Words(self), Packed(self)
        self.found = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1 and self.merged(p) == [p]:  # others can never come out of merging
                self.found.add_word(p, p)
        self.found.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again."""
        now = list(text)
        while len(now) > 1:
            scores = [self.score.get(a + b) for a, b in zip(now, now[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            now[at : at + 2] = [now[at] + now[at + 1]]
        return now

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens can stand side by side: merging their joined text gives them."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def last_tokens(self, word: str) -> list[str]:
        """The last token of each prefix; a character of its own wherever no longer piece fits."""
        last, settled, pairs, fits = list(word), -1, self.pairs, self.fits
        for end, piece in self.found.iter(word):
            if end == settled:
                continue
            at = end - len(piece)
            if at < 0 or (known := pairs.get((last[at], piece))) or (known is None and fits(last[at], piece)):
                last[end], settled = piece, end
        return last

    def word(self, word: str) -> bytes:
        """Packed ids of a word, recovered from its end."""
        last, out, at = self.last_tokens(word), [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return b"".join(map(self.packed.__getitem__, out))

    @staticmethod
    def pack(ids: array) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if sys.byteorder == "big":
            ids = array("I", ids)
            ids.byteswap()
        return ids.tobytes()

    @staticmethod
    def unpack(raw: bytes) -> array:
        ids = array("I")
        ids.frombytes(raw)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids

    def encoded(self, text: str | None, part: int = PART) -> Iterator[bytes]:
        """Packed ids of a text, part by part; begin and end are parts of their own."""
        text = text or ""
        yield self.pack(array("I", [self.begin]))
        at, head = 0, SPACE
        while at < len(text):
            cut = _CUT.search(text, at + part) if len(text) - at > part else None
            stop = cut.start() if cut else len(text)
            yield b"".join(map(self.words.__getitem__, self.split.findall(head + text[at:stop].replace(" ", SPACE))))
            at, head = stop, ""
        yield self.pack(array("I", [self.end]))

    def decoded(self, parts: Iterator[bytes]) -> Iterator[str]:
        """The text of packed ids: pieces joined, runs of byte pieces read as UTF-8 (a byte that is none becomes U+FFFD), the
        dummy prefix taken off.  ``parts`` split no run of byte pieces."""
        first = True
        for part in parts:
            ids = self.unpack(part)
            raw = b"".join(map(self.raw.__getitem__, ids))
            if first and raw:
                lead = next(i for i in ids if self.raw[i])
                if lead != self.unknown and lead not in self.bytes.values():
                    raw = raw.removeprefix(b" ")
                first = False
            yield raw.decode("utf-8", "each_byte")


def model(path: str) -> Model:
    """The model's tables, built once per worker."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` for every row, and with ``with_ids`` the ids (little-endian unsigned 32-bit)."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for b in batches:
            n, digest, back, raw = [], [], [], []
            for text in b.column(1):
                parts = list(m.encoded(text.as_py()))
                ids, texts = hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    ids.update(part)
                for piece in m.decoded(parts):
                    texts.update(piece.encode())
                n.append(sum(map(len, parts)) // 4)
                digest.append(ids.hexdigest())
                back.append(texts.hexdigest())
                raw.append(b"".join(parts) if with_ids else None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(lambda b: common.trimmed(run(b)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("piece_bpe_32k.model"))
