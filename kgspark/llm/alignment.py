"""Alignment of two tokenizers over a corpus, through a dictionary of distinct token groups.

A is a byte-level BPE (a JSON file), B a sentencepiece model with byte fallback.
Both encode one space and the whole text, without special tokens.  Byte offsets
where tokens of both end cut a document's tokens into groups; every A token of a
group is linked with every B token of it.

1. Documents are taken in packs of about ``PACK`` bytes of text, and their texts cut
   into units where no token of either tokenizer is cut; a worker encodes each
   distinct unit once.  A pack interns its distinct groups, expands the links of each distinct group once, and counts
   for every pair of ids the distinct documents that hold it: those of its group,
   or of several groups without repeats.
2. The pairs of all packs are added up: ``count`` is a pair's number of documents
   corpus-wide, and ``best`` says that no pair of its A id has more.
3. The distinct groups of all packs form the dictionary.  Each is expanded once,
   joined with the pairs, and summed to two numbers a group.
4. These go back by group key to the packs that hold the group, and there to the
   documents, multiplied by how often each document has the group.

What is exchanged grows with distinct groups and pairs for each pack, never with
token occurrences; a group that every document has is one row a pack.

Null and empty texts, and texts whose joined A or B bytes differ from space and
text, have no tokens: zeros and an empty ``groups``.  Repeated rows and ids are
documents of their own; a null doc_id stays.  Texts of any length are encoded
whole.  Other columns, of whatever name, are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.byte_bpe import read_ranks
from kgspark.llm.shared import written

#: Bytes of text whose groups are interned together.
PACK = 8 << 20
#: Distinct units, and characters of them, that a worker keeps between packs.
UNITS, CHARACTERS = 1 << 19, 1 << 26
#: Characters of units given to the tokenizers at a time.
BATCH = 1 << 18
#: Links of documents expanded at a time.
LINKS = 1 << 21
#: Tokens of neither tokenizer run on from any other character into a space: A's
#: pattern has spaces at the beginning of a match only, or white space alone, and
#: B's pieces have them in front.  A unit is a space and what follows, up to the
#: next space that has no white space before it.
UNIT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")

COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
#: Rows of documents (``no``, ``held``, ``times``), of groups (``key``) and of pairs (``a``).
_PACKED = _DOC + ", pack long, no int, held binary, times binary, key binary, g int, a int, b int, n long"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_LOADED: dict = {}


@dataclass
class Tokenizers:
    """Both tokenizers of a worker, and the bytes of every id (none: an id that stands for no bytes)."""

    a: object
    b: object
    bytes_a: list
    bytes_b: list
    cuts: bool  # no piece of B has a space after another character


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizers(a: bytes, b: bytes) -> Tokenizers:
    key = hash(a), hash(b)
    if key not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(a.decode())
        first.encode_special_tokens = True
        alphabet, special = byte_alphabet(), {t["content"] for t in json.loads(a).get("added_tokens", [])}
        bytes_a = [b""] * (max(first.get_vocab().values()) + 1)
        for token, i in first.get_vocab().items():
            if token not in special:
                bytes_a[i] = bytes(alphabet[c] for c in token)
        second = sentencepiece.SentencePieceProcessor(model_proto=b)
        bytes_b, cuts = [], True
        for i in range(second.get_piece_size()):
            piece = second.id_to_piece(i)
            if second.is_control(i) or second.is_unknown(i):
                bytes_b.append(b"")
            elif second.is_byte(i):
                bytes_b.append(bytes([int(piece[3:5], 16)]))
            else:
                bytes_b.append(piece.replace("▁", " ").encode())
                cuts &= "▁" not in piece.lstrip("▁")
        _LOADED[key] = Tokenizers(first, second, bytes_a, bytes_b, cuts)
    return _LOADED[key]


class Units(dict):
    """Distinct units of text by number, each encoded once by both tokenizers and cut into groups, distinct groups by number too."""

    def __init__(self, both: Tokenizers):
        super().__init__()
        self.both, self.waiting, self.size = both, [], 0
        self.counts = array("q")  # of each unit: A tokens, B tokens, groups, links, whether bytes differ
        self.flat, self.first = array("i"), array("q", [0])  # numbers of each unit's groups
        self.groups: dict[tuple, int] = {}
        self.texts: list[str] = []  # of each group

    def __missing__(self, unit: str) -> int:
        self[unit] = len(self)
        self.waiting.append(unit)
        self.size += len(unit)
        return len(self) - 1

    def encode(self) -> None:
        """Takes up the units that were numbered since the last time."""
        lo = 0
        while lo < len(self.waiting):
            hi, size = lo, 0
            while hi < len(self.waiting) and size < BATCH:
                size += len(self.waiting[hi])
                hi += 1
            units = self.waiting[lo:hi]
            first = self.both.a.encode_batch(units, add_special_tokens=False)
            second = self.both.b.encode([u[1:] for u in units], num_threads=1)
            for unit, x, y in zip(units, first, second):
                self._take(unit.encode(), x.ids, y)
            lo = hi
        self.waiting.clear()

    def _take(self, raw: bytes, a: list[int], b: list[int]) -> None:
        bytes_a, bytes_b, groups = self.both.bytes_a, self.both.bytes_b, self.groups
        if b"".join([bytes_a[t] for t in a]) != raw or b"".join([bytes_b[t] for t in b]) != raw:
            self.counts.extend((0, 0, 0, 0, 1))
            self.first.append(len(self.flat))
            return
        j = p = q = left = right = links = n = 0
        for i, t in enumerate(a, 1):
            left += len(bytes_a[t])
            while right < left:
                right += len(bytes_b[b[j]])
                j += 1
            if left == right:
                group = tuple(a[p:i]), tuple(b[q:j])
                at = groups.get(group)
                if at is None:
                    at = groups[group] = len(groups)
                    self.texts.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                self.flat.append(at)
                links += (i - p) * (j - q)
                n += 1
                p, q = i, j
        self.counts.extend((len(a), len(b), n, links, 0))
        self.first.append(len(self.flat))

    def form(self, number: int, names: list[tuple]) -> bytes:
        a, b = names[number]
        return np.array([len(a), *a, *b], np.int32).tobytes()


def units_of(both: Tokenizers, text: str) -> list[str]:
    """A space and the text, in units; a tokenizer B whose pieces may have spaces inside takes it whole."""
    if not both.cuts:
        return [" " + text]
    units = UNIT.findall(" " + text)
    if units[-1] == " " and len(units) > 1:  # a last space: B has nothing to encode after it
        units[-2:] = [units[-2] + " "]
    return units


class Pack:
    """Documents whose groups are interned together."""

    def __init__(self, units: Units):
        self.units, self.docs, self.size = units, [], 0

    def add(self, doc_id, text: str | None) -> None:
        """Notes a document's units by number."""
        self.size += len(text or "") + 64
        number = list(map(self.units.__getitem__, units_of(self.units.both, text))) if text else []
        self.docs.append((doc_id, np.array(number, np.int32)))

    def batches(self, pack: int, digest: bool) -> Iterator[pa.RecordBatch]:
        """Rows of groups, of pairs and of documents."""
        units = self.units
        units.encode()
        kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _PACKED.split(", "))])
        counts, flat, first = np.array(units.counts).reshape(-1, 5), np.array(units.flat), np.array(units.first)
        docs: dict[str, list] = {c: [] for c in ("doc_id", *COLUMNS, "groups")}
        held, times, used = [], [], []
        for doc_id, number in self.docs:
            sums = counts[number].sum(0)
            whole = len(number) > 0 and sums[4] == 0
            number = number if whole else number[:0]
            size = first[number + 1] - first[number]
            group = flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[number], size)]
            text = ";".join([units.texts[g] for g in group.tolist()])
            mine, n = np.unique(group, return_counts=True)
            used.append(mine)
            times.append(n.astype(np.int32).tobytes())
            for name, value in zip(docs, (doc_id, *(sums[:4] if whole else (0, 0, 0, 0)), hashlib.sha256(text.encode()).hexdigest() if digest and text else text)):
                docs[name].append(value)
        parts = []
        doc = np.repeat(np.arange(len(used)), [len(x) for x in used])
        found, number = np.unique(np.concatenate(used), return_inverse=True)  # the pack's own numbers of its groups
        bounds = np.searchsorted(doc, np.arange(len(used) + 1))
        held = [number[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes() for i in range(len(used))]
        if len(found):
            names = list(units.groups)
            forms = [units.form(g, names) for g in found.tolist()]
            parts.append({"key": forms, "g": list(range(len(forms)))})
            a, b, count = self.pair_documents(forms, doc, number)
            parts.append({"a": a, "b": b, "n": count})
        parts.append(docs | {"no": list(range(len(used))), "held": held, "times": times})
        for part in parts:
            size = len(next(iter(part.values())))
            for lo in range(0, size, 4096):
                hi = min(size, lo + 4096)
                columns = [pa.array(part[f.name][lo:hi], f.type) if f.name in part else pa.array([pack] * (hi - lo), f.type) if f.name == "pack" else pa.nulls(hi - lo, f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    @staticmethod
    def pair_documents(forms: list[bytes], doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, how many of the pack's documents hold the pair linked)."""
        group, a, b, _ = expanded(forms)
        pairs, pair = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        first = np.searchsorted(group, np.arange(len(forms) + 1))
        count, total = np.zeros(len(pairs), np.int64), np.diff(first)
        lo, grown = 0, np.cumsum(total[number])
        while lo < len(doc):  # whole documents, about LINKS links at a time
            hi = int(np.searchsorted(grown, (grown[lo - 1] if lo else 0) + LINKS, "right"))
            hi = int(np.searchsorted(doc, doc[max(hi - 1, lo)], "right"))
            size = total[number[lo:hi]]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[number[lo:hi]], size)
            held = np.unique(np.repeat(doc[lo:hi], size) * len(pairs) + pair[at])
            count += np.bincount(held % len(pairs), minlength=len(pairs))
            lo = hi
        return (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), count


def expanded(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the form, a, b, how many links) of each distinct pair of each form."""
    out = []
    for i, form in enumerate(forms):
        ids = np.frombuffer(form, np.int32)
        a, n_a = np.unique(ids[1 : 1 + ids[0]], return_counts=True) if ids[0] > 1 else (ids[1:2], np.ones(1, np.int64))
        b, n_b = np.unique(ids[1 + ids[0] :], return_counts=True) if len(ids) - ids[0] > 2 else (ids[1 + ids[0] :], np.ones(1, np.int64))
        out.append((np.full(len(a) * len(b), i), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(n_a, n_b).ravel()))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def packed(docs: DataFrame, a: str, b: str, digest: bool) -> DataFrame:
    context = docs.sparkSession.sparkContext
    files = context.broadcast((read_ranks(a), read_ranks(b)))  # two files of fixed size
    docs = docs.select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        both, number = tokenizers(*files.value), TaskContext.get().partitionId() << 32
        units = Units(both)
        pack = Pack(units)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                for doc_id, text in zip(*(c.slice(lo, 256).to_pylist() for c in batch.columns)):
                    pack.add(doc_id, text)
                    if pack.size >= PACK:
                        yield from pack.batches(number, digest)
                        if len(units) > UNITS or units.size > CHARACTERS:
                            units = Units(both)
                        pack, number = Pack(units), number + 1
        if pack.docs:
            yield from pack.batches(number, digest)

    return docs.mapInArrow(run, _PACKED)


def dictionary_links(groups: DataFrame) -> DataFrame:
    """(key, a, b, links) of each distinct group of ``groups`` (key)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                keys = batch.column(0).slice(lo, 1024)
                group, a, b, n = expanded(keys.to_pylist())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(group)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["key", "a", "b", "links"])

    return groups.select("key").mapInArrow(run, "key binary, a int, b int, links long")


def pair_counts(packs: DataFrame) -> DataFrame:
    """(a, b, count, best): documents corpus-wide, and whether no pair of the A id has more."""
    pairs = written(packs.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("a").agg(F.max("count").alias("most"))
    return pairs.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``a`` and ``b`` are paths of the two files on the driver.  ``n_best`` counts
    the links whose pair is among its A id's best, ``count_sum`` adds the counts
    of all links.  ``groups`` is the alignment as text, or its SHA-256 (``digest``).
    """
    packs = written(packed(docs, a, b, digest), "alignment", "zstd")
    groups = packs.where("key IS NOT NULL").select("pack", "key", "g")
    links = dictionary_links(groups.select("key").distinct()).join(pair_counts(packs), ["a", "b"])
    sums = links.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("count")).alias("total"))
    back = groups.join(sums, "key").select(F.col("pack").alias("to"), "g", "best", "total")
    held = packs.where("no IS NOT NULL").select("pack", "doc_id", *COLUMNS, "groups", "held", "times")

    def run(held: pa.Table, back: pa.Table) -> pa.Table:
        out = {"n_best": [], "count_sum": []}
        g = back["g"].to_numpy()
        sums = {}
        for name, column in (("n_best", "best"), ("count_sum", "total")):
            sums[name] = np.zeros(len(g), np.int64)
            sums[name][g] = back[column].to_numpy()
        for mine, times in zip(held["held"].to_pylist(), held["times"].to_pylist()):
            mine, times = np.frombuffer(mine, np.int32), np.frombuffer(times, np.int32)
            for name in out:
                out[name].append(int(sums[name][mine] @ times))
        held = held.select(["doc_id", *COLUMNS, "groups"])
        for i, name in enumerate(out):
            held = held.add_column(5 + i, name, pa.array(out[name], pa.int64()))
        return held

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return held.groupBy("pack").cogroup(back.groupBy("to")).applyInArrow(run, schema)
