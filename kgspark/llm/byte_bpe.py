"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Null text counts as empty and gives no ids.  Other columns, whatever their
names, stay as they are; ``ids`` and ``decoded`` are added (a column of that
name is replaced).  Ids that the rank file does not have raise an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.text import raw

#: A longer text is split before it is matched, at the next safe boundary.
PIECE = 1 << 16
#: Between a letter or digit and white space every match ends and another begins:
#: no alternative of the pattern runs from the one to the other, and the
#: look-ahead after white space never sees past a letter.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")

#: The matching engine's stack ends on such runs.  Without its last character
#: (which may belong to what follows) a run is one match of the pattern.
BLANK = regex.compile(r"\p{White_Space}{4096,}")

_LOADED: dict[tuple[int, str], object] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    key = hash(ranks), pattern
    if key not in _LOADED:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where no match is cut."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    ids, at = [], 0
    for run in BLANK.finditer(text) if len(text) >= 4096 else ():
        end = run.end() - (run.end() < len(text))
        ids += [i for part in pieces(text[at : run.start()]) for i in enc.encode_ordinary(part)]
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    return ids + [i for part in pieces(text[at:]) for i in enc.encode_ordinary(part)]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, the tokens of each whole text without special tokens.

    ``ranks`` is the path of a rank file on the driver; its bytes (a file of
    fixed size) are broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    docs = docs.drop("ids")
    at = docs.columns.index(text)

    def run(batches):
        enc = encoding(held.value, pattern)
        for batch in batches:
            column = batch.column(at)
            for lo, hi, _ in _spans(column):
                ids = [encode_text(enc, x or "") for x in column.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, pa.array(ids, pa.list_(pa.int32()))],
                    [*batch.schema.names, "ids"],
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for (they need not be valid UTF-8)."""
    held = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    tokens = tokens.drop("decoded")
    at = tokens.columns.index(ids)

    def run(batches):
        enc = encoding(held.value, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                out = [enc.decode_bytes(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass; the text itself is left out."""
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    docs = docs.select(*keep, text)

    def run(batches):
        enc = encoding(held.value, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi, _ in _spans(column):
                ids = [encode_text(enc, x or "") for x in column.slice(lo, hi - lo).to_pylist()]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], *new], [*keep, "ids", "decoded"])

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *new]))


def _spans(column: pa.Array) -> Iterator[tuple[int, int, None]]:
    """Ranges of rows with about 1 MB of text each."""
    _, offsets = raw(column)
    lo, start = 0, 0
    for i in range(1, len(column) + 1):
        if i == len(column) or offsets[i] - start > 1 << 20:
            yield lo, i, None
            lo, start = i, offsets[i]


def digests(tokens: DataFrame) -> DataFrame:
    """Lengths and SHA-256 of what ``encode`` and ``decode`` gave."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
