"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Rows are dealt to shards by a hash, each shard is packed on its own, and the
number of shards follows the number of rows (of ``sequences`` the number of
tokens too), so no task or bin depends on the size of the corpus and copies or a
large source are spread over all shards.  Bins do not depend on how the input is
partitioned or ordered.

Within a shard documents go largest first.  Open bins are kept in order of what
they have left and carry bitmaps: one bit for each duplicate cluster, and one
for each source and place (``per_source`` places: the first bitmap has the
sources that are in once, the second those in twice, and so on).  A document
takes the first bin, from the smallest sufficient residual upwards, whose
bitmaps have room for it; the search goes on to the next larger residual until
one is found, and opens a bin if there is none.

``pack`` gives the places of documents of known lengths; ``sequences`` builds the
bins themselves from token ids.

Defined results: a document longer than a bin gives full bins of its own and a
rest that is packed (the rest keeps the document's cluster and source); a document of zero or null length
has one row with null bin (and is in no sequence); null sources and null clusters
conflict with nothing; of equal lengths the smaller doc_id goes first; repeated
rows are packed once each, and are spread over all shards; other columns are not
read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.shared import written
from kgspark.llm.text import GAP

#: Documents of a shard, on average.
SHARD = 4096
#: Tokens of a shard of ``sequences``, on average.
SHARD_TOKENS = 1 << 23


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each document; -1 stands for no source and no cluster.  Lengths from 1 to capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list] = []  # cluster bitmap, source bitmaps
    free: list[tuple[int, int]] = []  # (residual, bin), sorted
    out = [-1] * len(lengths)
    for i in order:
        need = lengths[i]
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        at = bisect_left(free, (need, -1))
        while at < len(free) and (bins[free[at][1]][0] & cluster or bins[free[at][1]][per_source] & source):
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([0] * (per_source + 1))
        maps = bins[b]
        maps[0] |= cluster
        for k in range(per_source, 1, -1):
            maps[k] |= maps[k - 1] & source
        maps[1] |= source
        if left > need:
            insort(free, (left - need, b))
        out[i] = b
    return out


def placed(n: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int | None]]:
    """(document, piece, start, length, bin) of every piece; bins count from 0."""
    rest = [x % capacity for x in n]
    packed = [i for i in range(len(n)) if rest[i]]
    places = best_fit([rest[i] for i in packed], [sources[i] for i in packed], [clusters[i] for i in packed], capacity, per_source)
    bins = dict(zip(packed, places))
    next_bin = max(places, default=-1) + 1
    out = []
    for i, size in enumerate(n):
        full = size // capacity
        for k in range(full):
            out.append((i, k, k * capacity, capacity, next_bin))
            next_bin += 1
        if rest[i]:
            out.append((i, full, full * capacity, rest[i], bins[i]))
        elif not full:
            out.append((i, 0, 0, 0, None))
    return out


def _codes(source: pd.Series, cluster: pd.Series) -> tuple[list[int], list[int]]:
    """Small numbers for sources and clusters, -1 for none; a cluster with one member here needs no bit."""
    alone = cluster.map(cluster.value_counts()) > 1
    return pd.factorize(source)[0].tolist(), pd.factorize(cluster.where(alone))[0].tolist()


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    per_source: int = 2,
    doc_id: str = "doc_id",
    length: str = "n_tokens",
    source: str = "source",
    cluster: str = "cluster",
    shard_rows: int = SHARD,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id) for every piece of every row; ``bin_id`` is unique over all shards."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(length).cast("long").alias("n"),
        F.when(F.col(source).isNotNull(), F.xxhash64(source)).alias("source"),
        F.col(cluster).alias("cluster"),
    )
    # Repeated rows are one row with a number, then go their own ways.
    rows = written(rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count("*").alias("copies")), "lengths")
    shards = max(1, math.ceil((rows.agg(F.sum("copies")).first()[0] or 0) / shard_rows))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "n", "cluster", "copy"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n", "source", "copy"], kind="stable")
        base = int(pdf["shard"].iloc[0]) << 32
        places = placed(pdf["n"].fillna(0).astype("int64").tolist(), *_codes(pdf["source"], pdf["cluster"]), capacity, per_source)
        ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist()
        out = [(ids[i], piece, start, n, None if b is None else base + b) for i, piece, start, n, b in places]
        return pd.DataFrame(out, columns=["doc_id", "piece", "start", "n_tokens", "bin_id"]).astype({"doc_id": "Int64", "bin_id": "Int64"})

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "piece", "start", "n_tokens", "bin_id")])
    return rows.groupBy("shard").applyInPandas(run, schema)


def _numbered(rows: DataFrame) -> DataFrame:
    """(row, number) of the rows whose key repeats: the numbers from 1 of a key, which of its equal rows has which does not matter.

    A key's rows are counted by the partition that wrote them and numbered
    within it, so no task takes all rows of a key.  Written, so that Spark knows
    its size and sends it to the scans of the rows if that is small.
    """
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    copies = rows.join(often, "key", "left_semi").withColumn("part", F.shiftrightunsigned("row", 33))
    counts = copies.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).drop("n")
    own = copies.withColumn("own", F.row_number().over(Window.partitionBy("key", "part").orderBy("row")))
    return written(own.join(before, ["key", "part"]).select("row", (F.col("before") + F.col("own")).alias("number")), "copies")


def sequences(
    docs: DataFrame,
    capacity: int = 2048,
    per_source: int = 2,
    doc_id: str = "doc_id",
    ids: str = "ids",
    source: str = "source",
    cluster: str = "cluster",
    shard_rows: int = SHARD,
) -> DataFrame:
    """(bin_id, n_tokens, ids, doc_ids, starts): the bins, with the tokens of their pieces one after the other.

    starts has the place in the bin where each piece begins, doc_ids whose it is.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(F.col(source).isNotNull(), F.xxhash64(source)).alias("source"),
        F.col(cluster).alias("cluster"),
        F.col(ids).alias("ids"),
    )
    rows = rows.where(F.size("ids") > 0).withColumns({"key": F.xxhash64("doc_id", "source", "cluster", "ids"), "row": F.monotonically_increasing_id()})
    rows = written(rows, "token-ids")
    n_rows, n_tokens = rows.agg(F.count("*"), F.sum(F.size("ids"))).first()
    shards = max(1, math.ceil(n_rows / shard_rows), math.ceil((n_tokens or 0) / SHARD_TOKENS))
    rows = rows.join(_numbered(rows.select("key", "row")), "row", "left").withColumn("number", F.coalesce("number", F.lit(1)))
    rows = rows.drop("row").withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "key", "number"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        base = table.column("shard")[0].as_py() << 32
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "key", "number")]))
        column = pa.concat_arrays(table.column("ids").chunks)
        size = pc.fill_null(column.value_lengths(), 0).to_numpy()
        offsets = np.concatenate(([0], np.cumsum(size)))
        tokens = column.flatten().to_numpy()
        places = placed(size.tolist(), *_codes(*(table.column(c).to_pandas(integer_object_nulls=True) for c in ("source", "cluster"))), capacity, per_source)
        places = sorted((b, i, start, n) for i, _, start, n, b in places if b is not None)
        doc, starts, n_tokens, bins, parts = table.column("doc_id").to_pylist(), [], [], [], []
        members: list[list] = []
        for b, i, start, n in places:
            if not bins or bins[-1] != base + b:
                bins.append(base + b)
                n_tokens.append(0)
                starts.append([])
                members.append([])
            starts[-1].append(n_tokens[-1])
            members[-1].append(doc[i])
            n_tokens[-1] += n
            parts.append(tokens[offsets[i] + start : offsets[i] + start + n])
        bounds = pa.array(np.concatenate(([0], np.cumsum(n_tokens, dtype=np.int64))).astype(np.int32))
        values = pa.array(np.concatenate(parts) if parts else [], pa.int32())
        columns = [pa.array(bins, pa.int64()), pa.array(n_tokens, pa.int64()), pa.ListArray.from_arrays(bounds, values), pa.array(members, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["bin_id", "n_tokens", "ids", "doc_ids", "starts"])

    return rows.groupBy("shard").applyInArrow(run, "bin_id long, n_tokens long, ids array<int>, doc_ids array<long>, starts array<long>")


def clustered(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds cluster, equal for texts that differ in white space and case only."""
    return docs.withColumn("cluster", F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), GAP, " "))))
