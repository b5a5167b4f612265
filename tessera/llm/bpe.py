"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before a blank that follows a non-blank: no match of the split pattern crosses such a place
(none takes a blank after another character), and no lookahead sees over it, so the parts' ids are the text's ids.
Decoding returns raw bytes; nothing is replaced, so any text comes back bit by bit.  Null and empty texts have no
ids.  Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

PART = 16_384  # characters after which a text is cut at the next safe place
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n\t\r])")
_loaded: dict = {}


def codec(ranks_path: str, pattern: str):
    """The library's encoder, loaded once per worker."""
    if (ranks_path, pattern) not in _loaded:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        _loaded[ranks_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[ranks_path, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, enc, size: int = PART) -> array:
    ids = array("I")
    for part in parts(text or "", size):
        ids.extend(enc.encode_ordinary(part))
    return ids


def decode(ids, enc) -> bytes:
    return enc.decode_bytes(ids)


def _packed(ids: array) -> bytes:
    assert ids.itemsize == 4
    if array("I", [1]).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_table(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` for every row, and with ``with_ids`` the ids (little-endian unsigned 32-bit)."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks_path, pattern)
        for b in batches:
            n, digest, back, raw = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = encode(text, enc)
                packed = _packed(ids)
                n.append(len(ids))
                digest.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decode(ids.tolist(), enc)).hexdigest())
                raw.append(packed)
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

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_table(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
