"""Line dedup by pairwise patience alignment.

A line is what stands between line feeds; lines without a word take no part.
Only lines that several documents have matter, and of them only regions:
consecutive shared lines with at least ``min_chars`` characters together, since
a block that another document has lies in one.

Pairs are nominated by rare lines: of each region, the line that the fewest
documents have, of those that an earlier document has, leads to that line's
first holder, so a frequent line costs one pair for each document and not the
square, without a cap.  A pair is aligned by patience diff over the lines that
both have, and aligned blocks, consecutive in both and of at least ``min_chars``
characters, are deleted from the later document.  What is left of it is aligned
again until no block is found, so text that moved goes too.  Nothing is deleted
but by an alignment.

The exact fall-back for what this leaves: runs, the shortest runs of consecutive
lines with at least ``min_chars`` characters that start at each line and that
end at each line.  Each run that has lines left, and that an earlier document
has, is aligned by itself with its first holder.  No block is missed: each line
of a block of enough characters that an earlier document has is in the shortest
run from the block's first line, or in the shortest run that ends at the line,
and the block has that run, so the earlier document has it too, and its first
holder comes no later.  Rare lines find nearly all; runs are for blocks that
patience diff passes by, and for blocks put together from several documents.

Lines are equal if two 64-bit hashes with different seeds agree.

Defined results: null and empty texts lose nothing; documents are ordered by
doc_id, nulls last, then by a hash of the text; rows with the same doc_id and
text are one document, and each of them gets its result; blocks are matched
against the texts as they came in, not against what deletions left; other
columns stay as they are, whatever their names, but n_lines and n_removed are
replaced.

Hot lines: pairs meet line by line, so only lines that both documents have are
exchanged, and none of the joins has an aggregation on its keys before it, so
Spark splits the partitions of a line or holder that very many documents share.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import unused, written
from kgspark.llm.text import Spans

MIN_CHARS = 100
LAST = (1 << 63) - 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal items, increasing in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        first: dict[int, int] = {}
        for i in range(alo, ahi):
            first[a[i]] = -1 if a[i] in first else i
        there: dict[int, int] = {}
        for j in range(blo, bhi):
            there[b[j]] = -1 if b[j] in there else j
        once = [(i, there[x]) for x, i in first.items() if i >= 0 and there.get(x, -1) >= 0]
        # Longest increasing run of places in b, by piles.
        tops: list[int] = []
        last: list[int] = []
        back = [-1] * len(once)
        for k, (_, j) in enumerate(once):
            p = bisect_left(tops, j)
            back[k] = last[p - 1] if p else -1
            tops[p : p + 1] = [j]
            last[p : p + 1] = [k]
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(once[k])
            k = back[k]
        if not chain:
            continue
        out += chain
        edges = [(alo - 1, blo - 1), *reversed(chain), (ahi, bhi)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def common_blocks(a: list[tuple[int, int]], b: list[tuple[int, int, int]], min_chars: int) -> list[tuple[int, int]]:
    """Places in b, from and to, of aligned blocks; a: (place, line), b: (place, line, characters)."""
    found, start = [], None
    pairs = patience([x[1] for x in a], [x[1] for x in b])
    places = [(a[i][0], b[j][0], b[j][2]) for i, j in pairs]
    for k, (p, q, n) in enumerate(places):
        if start is None or (p, q) != (places[k - 1][0] + 1, places[k - 1][1] + 1):
            start, chars = q, 0
            found.append([q, q, 0])
        chars += n
        found[-1][1:] = [q + 1, chars]
    return [(lo, hi) for lo, hi, n in found if n >= min_chars]


def _key(doc_id: str, text: str):
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("h"))


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


DOC = "struct<id: long, h: long>"
HOLDERS = "array<struct<id: long, h: long, runs: array<struct<lo: int, hi: int>>>>"


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, flags): for each document that has lines to delete, whether a line goes, up to the last that does.

    doc is a struct of the doc_id and a hash of the text.
    """
    keyed = docs.select(_key(doc_id, text).alias("doc"), _lines(text).alias("all"))
    worded = F.filter(F.transform("all", lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda x: x.line.rlike(r"[^\x20\x09-\x0D]"))
    # Places count lines with words only, so blank lines do not part a block.
    line = lambda x: F.struct(F.xxhash64(x["line"]).alias("line"), F.xxhash64(F.lit("again"), x["line"]).alias("again"), F.length(x["line"]).alias("chars"), x["no"].alias("no"))
    held = keyed.select("doc", F.transform(worded, line).alias("lines")).where(F.size("lines") > 0)
    # Only the first row of a document that is repeated.
    held = written(held.groupBy("doc").agg(F.first("lines").alias("lines")), "lines")
    known = held.select("doc", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("line")
    known = written(known.agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where("docs > 1"), "shared")
    places = held.select("doc", F.posexplode("lines").alias("at", "x")).select("doc", "at", "x.*")
    places = places.join(known, "line").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "line", "again", "chars", "no", "docs", "first"))).alias("lines"))
    kind = places.schema["lines"].dataType.simpleString()
    regions = written(places.mapInArrow(_regions(min_chars), f"doc {DOC}, lines {kind}"), "regions")

    pairs = regions.mapInArrow(_nominated, f"doc {DOC}, lines {kind}, holders {HOLDERS}")
    gone = written(_aligned(pairs, regions, min_chars), "gone")

    runs = f"doc {DOC}, run long, lo int, hi int"
    holders = regions.withColumn("gone", F.array().cast("array<int>")).mapInArrow(_runs(min_chars), runs).groupBy("run")
    holders = holders.agg(F.min("doc").alias("holder"), F.max("doc").alias("other")).where("holder != other").select("run", "holder")
    left = regions.join(_by_document(gone), "doc", "left").select("doc", "lines", "gone").mapInArrow(_runs(min_chars), runs)
    left = left.join(holders, "run").where("holder < doc").groupBy("doc", "holder", "lo").agg(F.max("hi").alias("hi"))
    left = left.groupBy("doc", "holder").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    left = left.groupBy("doc").agg(F.collect_list(F.struct("holder.id", "holder.h", "runs")).alias("holders"))
    gone = gone.union(_aligned(regions.join(left, "doc"), regions, min_chars))

    def flagged(batches):
        for batch in batches:
            flags = []
            for numbers in batch.column(1):
                numbers = numbers.values.to_numpy()
                flags.append(np.bincount(numbers, minlength=numbers.max() + 1) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.list_(pa.bool_()))], ["doc", "flags"])

    return _by_document(gone).mapInArrow(flagged, f"doc {DOC}, flags array<boolean>")


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc").agg(F.flatten(F.collect_list("gone")).alias("gone"))


class _Flat:
    """The lines of a batch of documents one after the other."""

    def __init__(self, column: pa.ListArray):
        self.lines = column.flatten()
        self.size = column.value_lengths().to_numpy()
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.at, self.chars = self.field("at"), self.field("chars")
        new = np.ones(len(self.doc), bool)
        new[1:] = (np.diff(self.doc) != 0) | (np.diff(self.at) != 1)
        self.region = np.cumsum(new) - 1

    def field(self, name: str) -> np.ndarray:
        return self.lines.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _regions(min_chars: int):
    """(doc, shared lines) to those that stand in regions of enough characters."""

    def run(batches):
        for batch in batches:
            flat = _Flat(batch.column(1))
            keep = np.bincount(flat.region, flat.chars)[flat.region] >= min_chars if len(flat.region) else np.zeros(0, bool)
            size = np.bincount(flat.doc[keep], minlength=batch.num_rows)
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(size[size > 0]).astype(np.int32)))
            lines = pa.ListArray.from_arrays(pa.array(offsets), flat.lines.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(size > 0)), lines], ["doc", "lines"])

    return run


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_HOLDERS = pa.list_(pa.struct([("id", pa.int64()), ("h", pa.int64()), ("runs", _RUNS)]))


def _nominated(batches):
    """(doc, lines) to (doc, lines, holders): of each region, the first holder of its rarest line that an earlier document has."""
    for batch in batches:
        flat = _Flat(batch.column(1))
        mine = [batch.column(0).field(i).to_numpy().take(flat.doc) for i in (0, 1)]
        first = [flat.lines.field("first").field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        earlier = np.flatnonzero((first[0] < mine[0]) | ((first[0] == mine[0]) & (first[1] < mine[1])))
        order = earlier[np.lexsort((flat.at[earlier], flat.field("docs")[earlier], flat.region[earlier]))]
        rarest = order[np.unique(flat.region[order], return_index=True)[1]]
        holders: list[set] = [set() for _ in flat.size]
        for doc, i, h in zip(flat.doc[rarest].tolist(), first[0][rarest].tolist(), first[1][rarest].tolist()):
            holders[doc].add((i, h))
        some = pa.array([bool(x) for x in holders], pa.bool_())
        found = pa.array([[{"id": i, "h": h} for i, h in sorted(x)] for x in holders if x], _HOLDERS)
        yield pa.RecordBatch.from_arrays([*(c.filter(some) for c in batch.columns), found], ["doc", "lines", "holders"])


def _places(lines: pa.ListScalar) -> dict[tuple[int, int], list]:
    """Of each line, by both hashes: its characters, first holder, places, and numbers."""
    out: dict[tuple[int, int], list] = {}
    for x in lines.as_py():
        entry = out.setdefault((x["line"], x["again"]), [x["chars"], (x["first"]["id"], x["first"]["h"]), [], []])
        entry[2].append(x["at"])
        entry[3].append(x["no"])
    return out


def _batched(rows, kind: pa.Schema, size: int = 20_000):
    """Rows as record batches of a bounded number of rows."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)


_LINE = [("hid", pa.int64()), ("hh", pa.int64()), ("line", pa.int64()), ("again", pa.int64())]
_NUMBERS = pa.list_(pa.int32())


def _theirs(batches):
    rows = ((d["id"], d["h"], *key, x[2]) for batch in batches for d, lines in zip(batch.column(0).to_pylist(), batch.column(1)) for key, x in _places(lines).items())
    yield from _batched(rows, pa.schema([*_LINE, ("there", _NUMBERS)]))


def _mine(batches):
    """A row for each pair and line, but for lines whose first holder comes after the pair's; upto: where the run ends that begins at a place."""

    def rows():
        for batch in batches:
            for d, lines, holders in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                places = _places(lines)
                for h in holders:
                    holder = (h["id"], h["h"])
                    upto = {x["lo"]: x["hi"] for x in h["runs"] or ()}
                    inside = {p for lo, hi in upto.items() for p in range(lo, hi)}
                    for key, (chars, first, at, no) in places.items():
                        some = [(p, n, upto.get(p, 0)) for p, n in zip(at, no) if not upto or p in inside]
                        if some and first <= holder:
                            yield (*holder, *key, d["id"], d["h"], chars, *map(list, zip(*some)))

    yield from _batched(rows(), pa.schema([*_LINE, ("id", pa.int64()), ("h", pa.int64()), ("chars", pa.int32()), ("at", _NUMBERS), ("no", _NUMBERS), ("upto", _NUMBERS)]))


def _aligned(pairs: DataFrame, regions: DataFrame, min_chars: int) -> DataFrame:
    """(doc, gone): numbers of the lines of aligned blocks, for pairs of (doc, lines, holders)."""
    base = "hid long, hh long, line long, again long, "
    mine = pairs.select("doc", "lines", "holders").mapInArrow(_mine, base + "id long, h long, chars int, at array<int>, no array<int>, upto array<int>")
    theirs = regions.select("doc", "lines").mapInArrow(_theirs, base + "there array<int>")
    both = mine.join(theirs, ["hid", "hh", "line", "again"]).groupBy("hid", "hh", "id", "h")
    both = both.agg(F.collect_list(F.struct("chars", "at", "no", "upto", "there")).alias("lines")).select("id", "h", "lines")

    def run(batches):
        for batch in batches:
            out = []
            for lines in batch.column(2):
                a, b, numbers, upto = [], [], {}, {}
                for k, x in enumerate(lines.as_py()):
                    a.append(x["there"])
                    b += [(p, k, x["chars"]) for p in x["at"]]
                    numbers.update(zip(x["at"], x["no"]))
                    upto.update((p, hi) for p, hi in zip(x["at"], x["upto"]) if hi)
                find = aligned_runs(a, sorted(b), upto, min_chars) if upto else aligned_places(a, sorted(b), min_chars)
                out.append([numbers[p] for p in find])
            doc = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["id", "h"])
            yield pa.RecordBatch.from_arrays([doc, pa.array(out, _NUMBERS)], ["doc", "gone"])

    return both.mapInArrow(run, f"doc {DOC}, gone array<int>").where(F.size("gone") > 0)


def aligned_places(there: list[list[int]], b: list[tuple[int, int, int]], min_chars: int) -> list[int]:
    """Places in b of the blocks of its alignment with the holder, and of the alignments of what is left of b, until there is none.

    there: the places that each line has in the holder; b: (place, line, characters).
    """
    a = sorted((p, k) for k, places in enumerate(there) for p in places)
    out: set[int] = set()
    while blocks := common_blocks(a, b, min_chars):
        out.update(p for lo, hi in blocks for p in range(lo, hi))
        b = [x for x in b if x[0] not in out]
    return sorted(out)


def aligned_runs(there: list[list[int]], b: list[tuple[int, int, int]], upto: dict[int, int], min_chars: int) -> list[int]:
    """Places in b of runs, from a place up to another, that align with the part of the holder where they stand.

    The part is looked for at the places of the run's line that the holder has fewest of; equal runs are aligned once.
    """
    theirs = {p: k for k, places in enumerate(there) for p in places}
    at = {x[0]: x for x in b}
    known: dict[tuple, bool] = {}
    out: set[int] = set()
    for lo, hi in upto.items():
        run = [at[p] for p in range(lo, hi) if p in at]
        key = tuple(x[1] for x in run)
        if len(key) < hi - lo:  # one of the hashes of a line differs
            continue
        if key not in known:
            rarest = min(range(len(key)), key=lambda i: len(there[key[i]]))
            starts = (p - rarest for p in there[key[rarest]])
            starts = (p for p in starts if theirs.get(p) == key[0] and theirs.get(p + len(key) - 1) == key[-1])
            parts = ([(q, theirs[q]) for q in range(p, p + len(key)) if q in theirs] for p in starts)
            known[key] = any(common_blocks(part, run, min_chars) == [(lo, hi)] for part in parts)
        if known[key]:
            out.update(range(lo, hi))
    return sorted(out)


def _runs(min_chars: int):
    """(doc, lines, gone) to (doc, run, from place, to place): runs of the regions that are not gone as a whole."""

    def run(batches):
        for batch in batches:
            flat = _Flat(batch.column(1))
            n, at = flat.chars, np.arange(len(flat.doc))
            if not len(at):
                continue
            first = np.searchsorted(flat.region, flat.region, "left")
            last = np.searchsorted(flat.region, flat.region, "right")
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            ends = np.maximum(np.searchsorted(total, total[:-1] + min_chars, "left"), at + 1)
            starts = np.minimum(np.searchsorted(total, total[1:] - min_chars, "right") - 1, at)
            forward, back = ends <= last, starts >= first
            lo, hi = np.unique(np.stack((np.concatenate((at[forward], starts[back])), np.concatenate((ends[forward], at[back] + 1)))), axis=1)
            # Lines that are gone: a document's number and a line's number as one.
            went = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().fill_null(0).to_numpy())
            went = went << 32 | batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            stays = np.concatenate((np.zeros(1, np.int64), np.cumsum(~np.isin(flat.doc << 32 | flat.field("no"), went))))
            open_ = stays[hi] > stays[lo]
            lo, hi = lo[open_], hi[open_]
            runs = Spans(flat.field("line").view(np.uint64)).hash(lo, hi).view(np.int64)
            spans = (pa.array(x.astype(np.int32)) for x in (flat.at[lo], flat.at[hi - 1] + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat.doc[lo])), pa.array(runs), *spans], ["doc", "run", "lo", "hi"])

    return run


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with text without its repeated blocks, and n_lines and n_removed (long)."""
    doc, flags = unused(docs, "doc", "flags")
    gone = repeated_lines(docs, doc_id, text, min_chars).withColumnsRenamed({"doc": doc, "flags": flags})
    out = docs.join(gone.hint("shuffle_hash"), _key(doc_id, text) == gone[doc], "left")
    kept = F.filter(_lines(text), lambda x, i: ~F.coalesce(F.get(F.col(flags), i), F.lit(False)))
    return out.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(text))).cast("long"),
            "n_removed": F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0)).cast("long"),
            text: F.when(F.col(flags).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(doc, flags)
