"""Exact dedup by counting quotient filters, with byte verification.

Each partition packs the 64-bit fingerprints of its texts into counting quotient
filters, one for each range of quotients.  The filters of one range meet in one
task and merge without loss, as sorted remainders whose counters add up.  Only
texts whose fingerprint has a count above one are then compared byte by byte.

A filter's bitmaps have about as many bits as it has entries, so all filters
together take some ten bytes for each fingerprint, however many ranges there are.
The fingerprints to verify are a written table: Spark sends a small one to the
scan of the texts, so that others do not leave it, and joins a large one, whose
hot fingerprints it splits.

Defined results: null text is empty text; rows of equal text form one group,
repeated rows count once each; the smallest doc_id stays (a null doc_id only
where the whole group has none) and if several rows share it they all stay;
other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.shared import written
from kgspark.llm.text import GAP

#: Fingerprints that a filter of one quotient range is meant for.
RANGE = 1 << 21
#: Fingerprints that a task holds before it emits its filters.
HELD = 1 << 20


class QuotientFilter:
    """A set of fingerprints with counters, all with the same leading ``skip`` bits.

    The next ``q`` bits are the quotient: ``occupied`` has a bit for each one in
    use, ``run_end`` a bit for each entry that is the last of its quotient, and
    the entries keep the remaining bits, sorted.  Counters above one are kept
    apart, by entry.
    """

    def __init__(self, skip: int, prefix: int, values: np.ndarray, counts: np.ndarray, q: int | None = None):
        """values: sorted and distinct, unsigned.  There are about as many quotients as values, unless ``q`` is given."""
        q = max(3, len(values).bit_length() - 1) if q is None else q
        self.skip, self.prefix, self.q = skip, prefix, q
        left = np.uint64(64 - skip - q)
        quotients = (values >> left) & np.uint64((1 << q) - 1)
        self.occupied = np.zeros(1 << q, bool)
        self.occupied[quotients.astype(np.int64)] = True
        self.run_end = np.append(quotients[1:] != quotients[:-1], True)[: len(values)]
        self.remainders = values & np.uint64((1 << int(left)) - 1)
        self.many = np.flatnonzero(counts > 1)
        self.counters = counts[self.many]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        run = np.concatenate(([0], np.cumsum(self.run_end)[:-1])) if len(self.run_end) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        left = 64 - self.skip - self.q
        high = np.uint64(self.prefix << (64 - self.skip) if self.skip else 0)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.many] = self.counters
        return high | quotients << np.uint64(left) | self.remainders, counts

    def dump(self) -> bytes:
        parts = [
            np.packbits(self.occupied).tobytes(),
            np.packbits(self.run_end).tobytes(),
            self.remainders.tobytes(),
            self.many.astype(np.int64).tobytes(),
            self.counters.astype(np.int64).tobytes(),
        ]
        return struct.pack("<5q", self.skip, self.prefix, self.q, len(self.remainders), len(self.many)) + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        self = cls.__new__(cls)
        self.skip, self.prefix, self.q, n, m = struct.unpack_from("<5q", data)
        at = 40

        def take(size: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, size, at)
            at += out.nbytes
            return out

        self.occupied = np.unpackbits(take((1 << self.q) + 7 >> 3, np.uint8), count=1 << self.q).astype(bool)
        self.run_end = np.unpackbits(take(n + 7 >> 3, np.uint8), count=n).astype(bool)
        self.remainders, self.many, self.counters = take(n, np.uint64), take(m, np.int64), take(m, np.int64)
        return self

    @classmethod
    def merge(cls, filters: Iterable[QuotientFilter]) -> QuotientFilter:
        merged, parts = None, []
        for f in filters:
            merged = merged or f
            parts.append(f.items())
        values, counts = _added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return cls(merged.skip, merged.prefix, values, counts)


def _added(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), GAP, " ")


def repeated_fingerprints(prints: DataFrame, n_rows: int) -> DataFrame:
    """(fp): the values of the only column of ``prints`` that occur more than once."""
    skip = max(4, math.ceil(math.log2(max(1, n_rows / RANGE))))

    def build(batches):
        def emit(held):
            values, counts = _added(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            prefix = values >> np.uint64(64 - skip)
            at = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            ends = np.append(at, len(values))[1:]
            parts = [(int(prefix[a]), QuotientFilter(skip, int(prefix[a]), values[a:b], counts[a:b]).dump()) for a, b in zip(at, ends)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["range", "filter"])

        held: list[np.ndarray] = []
        for batch in batches:
            if len(batch):
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = QuotientFilter.merge(map(QuotientFilter.load, pdf["filter"])).items()
        return pd.DataFrame({"fp": values[counts > 1].view(np.int64)})

    filters = prints.mapInArrow(build, "range long, filter binary")
    return filters.groupBy("range").applyInPandas(merge, "fp long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("norm"))
    # One scan of the texts for fingerprints and digests.
    prints = rows.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    prints = written(prints, "fingerprints")
    again = written(repeated_fingerprints(prints.select("fp"), prints.count()), "counted")
    # The texts themselves are the key here, so Spark compares their bytes; the
    # copies that a task has are one row before they are exchanged.
    groups = (
        rows.withColumn("fp", F.xxhash64("norm"))
        .join(again, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.col("fp").alias("gfp"), F.sha2("norm", 256).alias("gsha"), "keep_id", "group_size")
    )
    groups = written(groups, "groups")
    out = prints.join(groups, (F.col("fp") == F.col("gfp")) & (F.col("text_sha256") == F.col("gsha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
