"""Token counts of a unigram segmentation, by a trie of distinct pre-tokens.

A pre-token is a word behind the mark U+2581.  The pieces and their order come
from a public SentencePiece file; the log probability of the piece of rank r
(from 1) is Zipf's, -ln(r) - ln(H), where H sums 1/r.  A character without a
piece falls back to the bytes of its UTF-8 form, each at ``BYTE_COST`` below the
rarest piece.  The forward score of a prefix is that of its best segmentation
(on ties, the one with fewer tokens), so it is computed once for each node of
the trie and words that share a prefix share the work.

The documents are packed, some megabytes of text at a time, into rows that have
their distinct words once, sorted, and for each document the numbers of its words
and how often it has them.  Each row's words are cut into ranges that all rows
share (from quantiles of a bounded sample of the words; they decide who scores a
word, not how).  The words of a range meet in one task, which is the trie of its
words: walked depth first, with one path in memory, every node is scored once,
and the number of tokens is kept for terminal nodes.  The counts go back to the
rows in the order of their words, and each document adds up.  A word that all
documents have is one entry for each packed row.

Defined results: null and word-less texts have no tokens; repeated rows count
each; other columns stay as they are, but n_words and n_tokens are replaced.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.shared import written
from kgspark.llm.text import chunks, got, put, ranges, raw, sums

#: Bytes of text of a packed row; a longer document makes a row of its own.
PACK = 12 << 20
#: Words of a range, with repeats in packs, and of the sample that parts ranges, about.
RANGE_WORDS, SAMPLE = 400_000, 20_000

MARK = "▁"
BYTE_COST = 10.0

_LOADED: dict[int, tuple[dict[str, float], float]] = {}


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece file in order of rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def scores(pieces: list[str]) -> tuple[dict[str, float], float]:
    """Log probabilities of the pieces, and of a byte."""
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    table = {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}
    return table, -math.log(len(pieces)) - norm - BYTE_COST


def terminal_counts(words: Iterable[str], table: dict[str, float], byte: float) -> dict[str, int]:
    """Tokens of each distinct word."""
    # The length of the longest piece by its last two characters: others need no look at longer ones.
    longest: dict[str, int] = {}
    for piece in table:
        longest[piece[-2:]] = max(longest.get(piece[-2:], 1), len(piece))
    get = table.get
    path, score, count = MARK, [0.0], [0]
    out = {}

    def extend(i: int) -> None:
        """The forward score of path[:i] from those of its prefixes."""
        size = len(path[i - 1].encode(errors="surrogatepass"))
        best, tokens = score[i - 1] + size * byte, count[i - 1] + size
        for j in range(max(0, i - longest.get(path[max(0, i - 2) : i], 1)), i):
            s = get(path[j:i])
            if s is not None:
                s += score[j]
                if s > best or s == best and count[j] + 1 < tokens:
                    best, tokens = s, count[j] + 1
        score.append(best)
        count.append(tokens)

    extend(1)
    for word in sorted(words):
        word = MARK + word
        shared, most = 1, min(len(word), len(path))
        while shared < most and word[shared] == path[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        path = word
        for i in range(shared + 1, len(word) + 1):
            extend(i)
        out[word[1:]] = count[-1]
    return out


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(pack, words, docs, at, n): distinct words; documents with their numbers of words and of distinct words; which those are, and how often.

    Of document d the word w is number ``d * len(words) + w``; ``at`` has the steps from one number to the next.
    """
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_tokens")]
    docs = docs.select(F.struct(*keep, F.lit(True).alias("_")).alias("row"), text)
    doc = T.StructType([docs.schema.fields[0], T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.IntegerType())])
    schema = T.StructType(
        [T.StructField("pack", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("docs", T.ArrayType(doc))]
        + [T.StructField(c, T.BinaryType()) for c in ("at", "n")]
    )

    def one(rows: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        # A chunk at a time: of a whole pack only the numbers of its words and the distinct words are held.
        parts, spelled = [], []
        for lo, _, words in chunks(texts):
            own, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            body = words.data.tobytes()
            spelled.append(pa.array([body[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())], pa.binary()))
            parts.append((lo, words.counts, own, which.astype(np.int32)))
        known, first = np.unique(np.concatenate([own for _, _, own, _ in parts]), return_index=True)
        distinct = pa.concat_arrays(spelled).take(pa.array(first))
        order = pc.sort_indices(distinct)
        distinct, place, many = distinct.take(order), np.empty(len(known), np.int64), max(1, len(known))
        place[order.to_numpy()] = np.arange(len(known))
        found = []
        for lo, counts, own, which in parts:
            owner = np.repeat(np.arange(lo, lo + len(counts)), counts)
            found.append(np.unique(owner * many + place[np.searchsorted(known, own)][which], return_counts=True))
        key, n = (np.concatenate(x) for x in zip(*found))
        size = np.bincount(key // many, minlength=len(rows)).astype(np.int32)
        n_words = np.concatenate([counts for _, counts, _, _ in parts]).astype(np.int64)
        whole = pa.StructArray.from_arrays([rows, pa.array(n_words), pa.array(size)], ["row", "n_words", "n_distinct"])
        whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), whole)
        strings = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.string()))
        columns = [pa.array([uuid.uuid4().int >> 65], pa.int64()), strings, whole, pa.array([put(np.diff(key, prepend=0), np.uint16)]), pa.array([put(n)])]
        return pa.RecordBatch.from_arrays(columns, ["pack", "words", "docs", "at", "n"])

    def run(batches):
        held, size = [], 0

        def together():
            rows, texts = (held[0].column(i) if len(held) == 1 else pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            for lo, hi in ranges(raw(texts)[1], PACK):
                yield one(rows.slice(lo, hi - lo), texts.slice(lo, hi - lo))

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= PACK:
                yield from together()
                held, size = [], 0
        if held:
            yield from together()

    return docs.mapInArrow(run, schema)


def edges(packs: DataFrame) -> list[bytes]:
    """Words that begin the ranges but the first, as quantiles of at most about ``SAMPLE`` words."""
    n = packs.agg(F.sum(F.size("words"))).first()[0] or 0
    some = F.pmod(F.xxhash64("pack", "word"), F.lit(max(1, n // SAMPLE))) == 0
    sample = sorted(r[0].encode() for r in packs.select("pack", F.explode("words").alias("word")).where(some).select("word").collect()) if n else []
    ranges = max(12, n // RANGE_WORDS)
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def terminals(packs: DataFrame, pieces_path: str) -> DataFrame:
    """(of, range, tokens): for each pack and range the tokens of its words, in order."""
    names = read_pieces(pieces_path)  # of a file of fixed size
    key = hash(tuple(names))
    held = packs.sparkSession.sparkContext.broadcast((names, edges(packs)))

    def cut(batches):
        for batch in batches:
            for pack, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.values
                if not len(words):
                    continue
                binary = words.cast(pa.binary())
                at = [0, *(bisect_left(_Items(binary), edge) for edge in held.value[1]), len(words)]
                rows = [(pack, r, a, b) for r, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                lists = pa.ListArray.from_arrays(pa.array([x[2] for x in rows] + [len(words)], pa.int32()), words)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), lists], ["of", "range", "words"])

    def scored(table: pa.Table) -> pa.Table:
        if key not in _LOADED:
            _LOADED[key] = scores(held.value[0])
        lists = [x.values.to_pylist() for x in table.column("words")]
        found = terminal_counts(set().union(*lists), *_LOADED[key])
        tokens = pa.array([put(np.fromiter(map(found.__getitem__, x), np.int64, len(x))) for x in lists], pa.binary())
        return pa.Table.from_arrays([table.column("of"), table.column("range"), tokens], ["of", "range", "tokens"])

    cuts = packs.select("pack", "words").mapInArrow(cut, "of long, range int, words array<string>")
    return cuts.groupBy("range").applyInArrow(scored, "of long, range int, tokens binary")


class _Items:
    """Values of an array by number, for bisection."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, i: int) -> bytes:
        return self.array[i].as_py()


def count_tokens(docs: DataFrame, pieces_path: str, text: str = "text") -> DataFrame:
    """Adds n_words and n_tokens (long) to every row; the text itself is left out."""
    packs = written(packed(docs, text), "packs", "zstd")
    row = packs.schema["docs"].dataType.elementType["row"].dataType
    schema = T.StructType([*row.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def added(pack: pa.Table, answers: pa.Table) -> pa.Table:
        docs = pa.concat_arrays([x.flatten() for x in pack.column("docs").chunks])
        order = np.argsort(answers.column("range").to_numpy())
        tokens = np.concatenate([got(x) for x in answers.column("tokens").take(pa.array(order)).to_pylist()] or [np.zeros(0, np.int64)])
        at = np.cumsum(got(pack.column("at")[0].as_py(), np.uint16)) % max(1, len(tokens))
        bounds = np.concatenate(([0], np.cumsum(docs.field("n_distinct").to_numpy())))
        total = sums(tokens[at] * got(pack.column("n")[0].as_py()), bounds)
        fields = docs.field("row").flatten()[:-1]
        return pa.Table.from_arrays([*fields, docs.field("n_words"), pa.array(total)], schema.names)

    out = packs.select("pack", "docs", "at", "n").groupBy("pack").cogroup(terminals(packs, pieces_path).groupBy("of"))
    return out.applyInArrow(added, schema)
