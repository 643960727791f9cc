"""Substring dedup by recompression.

Every document is parsed bottom up into symbols: maximal runs of one token get a
name, then, round by round, neighbours x y get a name if x is on the left side
and y on the right side of that round's split of all names in two.  A name is a
64-bit hash of what it stands for and its round, and the side is a bit of the
name, so names and sides are global and equal everywhere without a table of
names to exchange, and a round needs no shuffle of its own.

Whether a symbol stands at a place depends on the few words around it, its
support.  Symbols whose support lies inside a window are the window's interior:
an equal window anywhere has the same ones at the same places.  Each window is
filed under one of them, the longest of the highest round that has any.  The
first exchange finds the names that occur at two places of different texts;
only windows filed under shared names can repeat.  The second exchange brings
those windows' 128-bit hashes together by name and finds each one's earliest
start; all others repeat it.

Keys travel packed in arrays, one row for each batch and bucket, and a batch
sends one entry for each name or window at most: within the batch repeats are
already settled.  So a passage that a third of all documents share is no larger
in its bucket than there are batches.  Documents whose whole word sequences are
equal (by SHA-256) are settled first.

Defined results: null and short texts have no windows and lose nothing; a null
doc_id counts as larger than any other; rows with equal doc_id count as one
place, so equal windows at the same start in both are not repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import written
from kgspark.llm.text import GAP, chunks, joined, mix, raw, window_hashes

WINDOW = 20
ROUNDS = 3
#: Windows that a task holds before it sends them.
HELD = 1 << 20
#: Words for each bucket of the exchanges.
BUCKET_WORDS = 3_000_000
LAST = (1 << 63) - 1  # stands for a null doc_id
_SALT = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


class Symbols:
    """One round's symbols of a chunk: names, the words [s, e) they stand for, and supports [a, b)."""

    def __init__(self, name, s, e, a, b, doc):
        self.name, self.s, self.e, self.a, self.b, self.doc = name, s, e, a, b, doc


def letters(hashes: np.ndarray, doc: np.ndarray) -> Symbols:
    at = np.arange(len(hashes))
    return Symbols(hashes, at, at + 1, at, at + 1, doc)


def runs(x: Symbols) -> Symbols:
    """Maximal runs of equal names as one symbol each.  Both neighbours are support: they end the run.

    At the edge of a document the support reaches outside it, where no window does.
    """
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at, n)[1:]
    size = (end - at).astype(np.uint64)
    name = np.where(size > 1, mix(x.name[at] + size * _SALT), x.name[at])
    return Symbols(name, x.s[at], x.e[end - 1], x.s[at] - 1, x.e[end - 1] + 1, x.doc[at])


def pairs(x: Symbols, number: int) -> Symbols:
    """A round: name each neighbouring left-side and right-side symbol together."""
    n = len(x.name)
    left = mix(x.name ^ mix(np.array([number + 1], np.uint64))) >> np.uint64(63) == 1
    mate = np.zeros(n, bool)  # same document as the next
    mate[:-1] = x.doc[1:] == x.doc[:-1]
    first = mate.copy()
    first[:-1] &= left[:-1] & ~left[1:]
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    name = np.where(first, mix(x.name * np.uint64(0xD6E8FEB86659FD93) + x.name[nxt] + np.uint64(number)), x.name)
    e = np.where(first, x.e[nxt], x.e)
    # A lone left-side symbol depends on what follows, a lone right-side one on what precedes.
    b = np.where(left, np.where(mate, x.b[nxt], x.b + 1), x.b)
    prev = np.maximum(np.arange(n) - 1, 0)
    has = np.zeros(n, bool)
    has[1:] = mate[:-1]
    a = np.where(left, x.a, np.where(has, x.a[prev], x.a - 1))
    keep = ~second
    return Symbols(name[keep], x.s[keep], e[keep], a[keep], b[keep], x.doc[keep])


def _longest_inside(x: Symbols, at: np.ndarray, window: int) -> np.ndarray:
    """Index of the longest symbol (then by name, then leftmost) with support in each window, or -1.

    Supports are monotone, so a window's interior is a range of symbols.
    """
    n = len(x.name)
    if not n:
        return np.full(len(at), -1)
    lo = np.searchsorted(x.a, at)
    hi = np.searchsorted(x.b, at + window, "right")
    size = np.maximum(hi - lo, 0)
    index = np.arange(n, dtype=np.uint64)
    span = np.minimum(x.e - x.s, 63).astype(np.uint64)
    score = span << np.uint64(58) | x.name >> np.uint64(30) << np.uint64(24) | (_LOW - (index & _LOW))
    best = np.zeros(len(at), np.uint64)
    table, width = score, 1
    while True:
        fits = (size >= width) & (size < 2 * width)
        f = np.flatnonzero(fits)
        best[f] = np.maximum(table[lo[f]], table[hi[f] - width])
        if 2 * width > size.max(initial=0):
            break
        table = np.maximum(table[:-width], table[width:])
        width *= 2
    found = (_LOW - (best & _LOW)).astype(np.int64)
    found = lo + (found - lo & int(_LOW))
    return np.where(size > 0, found, -1)


def filed(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(name, doc, from, to): windows that start at ``from`` to ``to`` - 1 are filed under ``name``."""
    levels = [letters(hashes, doc)]
    levels.append(runs(levels[0]))
    for k in range(rounds):
        levels.append(pairs(levels[-1], k))
    name = np.zeros(len(at), np.uint64)
    which = np.full(len(at), -1)
    open_ = np.arange(len(at))
    for k, level in reversed(list(enumerate(levels))):
        i = _longest_inside(level, at[open_], window)
        got = i >= 0
        to = open_[got]
        name[to] = mix(level.name[i[got]] + np.uint64(k))
        which[to] = i[got] * len(levels) + k
        open_ = open_[~got]
        if not len(open_):
            break
    new = np.ones(len(at), bool)
    new[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(at))[1:] - 1
    return name[first], doc[at[first]], at[first], at[last] + 1


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _runs_of(k: np.ndarray, root: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, root, from, to) of runs of consecutive positions."""
    order = np.lexsort((pos, root, k))
    k, root, pos = k[order], root[order], pos[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (root[1:] != root[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at, len(k))[1:] - 1
    return k[at], root[at], pos[at], pos[end] + 1


def _pack(bucket: np.ndarray, fields: list[np.ndarray]) -> list[list]:
    """Rows (bucket, bytes of each field) with the entries of each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, fields = bucket[order], [f[order] for f in fields]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    end = np.append(at, len(bucket))[1:]
    return [[int(bucket[i]), *(f[i:j].tobytes() for f in fields)] for i, j in zip(at, end)]


def _table(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for c, n in zip(columns, names)], names)


def _cat(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def digests(docs: DataFrame) -> DataFrame:
    """(k, doc_id, n_words, sha, root) of rows of doc_id and text: sha of the words joined by single spaces."""

    def run(batches):
        for batch in batches:
            n, sha = [], []
            data, offsets = raw(batch.column(1))
            for i in range(len(batch)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(map(_root, sha), pa.int64())], ["doc_id", "n_words", "sha", "root"])

    out = docs.mapInArrow(run, "doc_id long, n_words long, sha binary, root long")
    return out.withColumn("k", F.coalesce("doc_id", F.lit(LAST)))


def _root(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def shared_names(docs: DataFrame, buckets: int, window: int, rounds: int) -> DataFrame:
    """(root, name, lo, hi): windows of the text with that root that are filed under shared names."""
    names = ["bucket", "name", "root", "lo", "hi", "flag"]

    def send(held: list[tuple]) -> pa.RecordBatch:
        name, root, lo, hi = (np.concatenate(x) for x in zip(*held))
        # Copies in the batch have equal roots and places: one entry.
        order, at = _groups(name, root, lo)
        pick = order[at]
        name, root, lo, hi = name[pick], root[pick], lo[pick], hi[pick]
        order, at = _groups(name)
        size = np.diff(np.append(at, len(order)))
        known = np.zeros(len(name), bool)
        known[order] = np.repeat(size > 1, size)
        flag = known.astype(np.uint8)  # 1: shared already; one entry tells the other batches
        tell = order[at]
        rest = known.copy()
        rest[tell] = False
        flag[rest] = 2  # shared already, and told: only passes
        # Those that only pass go round the buckets by root, lest a frequent name load one.
        bucket = (np.where(rest, mix(root.view(np.uint64) + name), name) % np.uint64(buckets)).astype(np.int32)
        return _table(_pack(bucket, [name, root, lo, hi, flag]), names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, words in chunks(batch.column(0)):
                at = words.windows(window)
                if not len(at):
                    continue
                owner = words.owner()
                name, doc, lo, hi = filed(words.hashes(), owner, at, window, rounds)
                root = np.zeros(len(words.first) - 1, np.int64)
                for d in np.unique(doc):
                    root[d] = _root(hashlib.sha256(joined(words, d)[0]).digest())
                base = words.first[doc]
                held.append((name, root[doc], (lo - base).astype(np.int32), (hi - base).astype(np.int32)))
                size += len(name)
                if size >= HELD // 2:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        name, root = _cat(pdf["name"], np.uint64), _cat(pdf["root"], np.int64)
        lo, hi, flag = _cat(pdf["lo"], np.int32), _cat(pdf["hi"], np.int32), _cat(pdf["flag"], np.uint8)
        told = np.flatnonzero(flag < 2)
        order, at = _groups(name[told])
        place = mix(root[told].view(np.uint64) + lo[told].astype(np.uint64) * _SALT)[order]
        size = np.diff(np.append(at, len(order)))
        shared = flag == 2
        if len(at):
            many = np.minimum.reduceat(place, at) != np.maximum.reduceat(place, at)
            many |= np.maximum.reduceat(flag[told][order], at) == 1
            shared[told[order]] = np.repeat(many, size)
        return pd.DataFrame({"root": root[shared], "name": name[shared].view(np.int64), "lo": lo[shared], "hi": hi[shared]})

    sent = docs.select("text").mapInArrow(run, "bucket int, name binary, root binary, lo binary, hi binary, flag binary")
    return sent.groupBy("bucket").applyInPandas(merge, "root long, name long, lo int, hi int")


def repeats(found: DataFrame, buckets: int, window: int) -> DataFrame:
    """(k, root, lo, hi): windows of a document from lo to hi - 1 that start earlier too.

    ``found`` has k, root, text, and the arrays name, lo, hi of windows to look
    at.  Windows are equal if both 64-bit hashes of them agree.
    """
    names = ["bucket", "h1", "h2", "k", "root", "pos", "gone"]

    def settle(h1, h2, k, pos) -> np.ndarray:
        """Marks all but the earliest of equal windows, and of rows at the same place, none."""
        order = np.lexsort((pos, k, h2, h1))
        new = np.ones(len(order), bool)
        a, b = h1[order], h2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = np.zeros(len(order), bool)
        gone[order] = (k[order] != k[first]) | (pos[order] != pos[first])
        return gone

    def send(held: list[tuple]) -> pa.RecordBatch:
        name, h1, h2, k, root, pos = (np.concatenate(x) for x in zip(*held))
        gone = settle(h1, h2, k, pos)
        bucket = (name % np.uint64(buckets)).astype(np.int32)
        stay = ~gone
        out = [[*row, b""] for row in _pack(bucket[stay], [h1[stay], h2[stay], k[stay], root[stay], pos[stay]])]
        done = np.stack([x.astype(np.int64) for x in _runs_of(k[gone], root[gone], pos[gone])], 1)
        by = (mix(done[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        out += [[b, b"", b"", b"", b"", b"", done[by == b].tobytes()] for b in np.unique(by).tolist()]
        return _table(out, names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            k, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo_row, hi_row, words in chunks(batch.column(2)):
                part = [batch.column(c).slice(lo_row, hi_row - lo_row) for c in (3, 4, 5)]
                name, lo, hi = (x.flatten().to_numpy() for x in part)
                which = np.repeat(np.arange(hi_row - lo_row), part[0].value_lengths().to_numpy())
                n = (hi - lo).astype(np.int64)
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                doc, name = np.repeat(which, n), np.repeat(name.view(np.uint64), n)
                at = words.first[doc] + pos
                h1 = window_hashes(words.hashes(), window)[at]
                h2 = window_hashes(words.hashes(1), window)[at]
                held.append((name, h1, h2, k[lo_row:hi_row][doc], root[lo_row:hi_row][doc], pos.astype(np.int32)))
                size += len(pos)
                if size >= HELD:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _cat(pdf["h1"], np.uint64), _cat(pdf["h2"], np.uint64)
        k, root, pos = _cat(pdf["k"], np.int64), _cat(pdf["root"], np.int64), _cat(pdf["pos"], np.int32)
        gone = settle(h1, h2, k, pos)
        found = _runs_of(k[gone], root[gone], pos[gone].astype(np.int64))
        done = _cat(pdf["gone"], np.int64).reshape(-1, 4)
        return pd.DataFrame({c: np.concatenate((found[i], done[:, i])) for i, c in enumerate(("k", "root", "lo", "hi"))})

    sent = found.select("k", "root", "text", "name", "lo", "hi").mapInArrow(run, "bucket int, h1 binary, h2 binary, k binary, root binary, pos binary, gone binary")
    return sent.groupBy("bucket").applyInPandas(merge, "k long, root long, lo long, hi long")


def remaining(found: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(k, sha, n_removed, kept_sha, kept_text) of rows k, text, sha and arrays lo, hi of repeated windows."""

    def run(batches):
        for batch in batches:
            out = []
            text = batch.column(1)
            for i in range(len(batch)):
                data, offsets = raw(text.slice(i, 1))
                words = data.tobytes().split()
                sha = batch.column(2)[i].as_py()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, batch.column(3)[i].values.to_numpy(), 1)
                np.add.at(edge, batch.column(4)[i].values.to_numpy() + window - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((batch.column(0)[i].as_py(), sha, int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode() if with_text else None))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "sha", "n_removed", "kept_sha", "kept_text"])

    return found.select("k", "text", "sha", "lo", "hi").mapInArrow(run, "k long, sha binary, n_removed long, kept_sha binary, kept_text string")


def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha, kept_text) for every row of ``docs``.

    kept_sha is the SHA-256 of the kept words joined by single spaces.  kept_text
    has those words for documents that lost some but not all, if asked for.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    all_ = written(digests(docs), "digests")
    buckets = max(12, int(all_.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS)
    firsts = all_.groupBy("sha", "root", "n_words").agg(F.min("k").alias("first"))
    firsts = written(firsts, "firsts")
    roots = firsts.where(F.col("n_words") >= window).select("root", F.col("first").alias("k"), "sha")
    names = shared_names(docs, buckets, window, rounds)
    names = names.groupBy("root").agg(*(F.collect_list(c).alias(c) for c in ("name", "lo", "hi")))
    found = names.join(roots, "root").select("k", "root", "sha", "name", "lo", "hi")
    # By the words, too: rows that share a doc_id, or have none, do not meet.
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " "))
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.sha2(plain, 256).alias("hex"), "text")
    keyed = keyed.select("k", F.unhex("hex").alias("sha"), "text")
    found = written(keyed.join(found.hint("shuffle_hash"), ["k", "sha"]).select("k", "root", "sha", "text", "name", "lo", "hi"), "found")
    gone = repeats(found, buckets, window)
    gone = gone.groupBy("k", "root").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    rest = remaining(found.select("k", "root", "text", "sha").join(gone.hint("shuffle_hash"), ["k", "root"]), window, with_text).dropDuplicates(["k", "sha"])
    rest = rest.select(F.col("k").alias("rk"), F.col("sha").alias("rsha"), "n_removed", "kept_sha", "kept_text")
    out = all_.join(firsts.drop("root", "n_words"), "sha").join(rest, (F.col("k") == F.col("rk")) & (F.col("sha") == F.col("rsha")), "left")
    copy = (F.col("k") > F.col("first")) & (F.col("n_words") >= window)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.unhex(F.sha2(F.lit("").cast("binary"), 256))).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
        F.when(~copy, F.col("kept_text")).alias("kept_text"),
    )
