"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

Vectors of integers are compared by inner product.  With one more component,
sqrt(m - |x|^2) for the largest squared norm m, and zero for anchors, a higher
product is a smaller Euclidean distance, so bounds from the triangle inequality
hold.

1. Some rows, chosen by a hash of their id, are pivots; every row belongs to the
   cell of its nearest pivot, and so does every anchor.
2. Positives.  For each label, the smallest distances between cells' rows and
   their pivots bound how far the k-th neighbour of any anchor of a cell can be.
   A row of a cell goes to a group of anchor cells only if its distance to its
   pivot lies in a range that this bound leaves.
3. Negatives.  Each anchor and positive ask for scores in a window below the
   positive's score: an annulus around the anchor.  Again a range of distances to
   the pivot remains for each pair of an anchor cell and a cell of rows.
4. Each group of anchors meets the rows that it was sent in an exact local join;
   what is first in each part is merged.

Bounds decide only where rows are sent: the result does not depend on pivots,
groups or parts.  Hot cells and labels are split: groups of anchors into blocks
of about ``ANCHORS``, the rows that they are sent by a hash into parts of about
``PART``.

Defined results: rows with a null vec_id, label or vector or a null or
non-finite component take no part; a shorter vector reads as if zeros followed;
repeated rows are rows of their own, and anchors each; an anchor is not its own
positive, but another row with its id may be; ties go by smaller vec_id; an empty
table gives no rows.  Squared norms (after rounding) of 2**53 and more raise an
error, so that all products are exact.  Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.shared import written

#: Pivots at most; a quarter of the square root of the number of rows is taken.
PIVOTS = 256
#: Anchors that a block has, about.
ANCHORS = 4096
#: Rows sent to a block that one task takes, about, at least and at most.
PART = (4096, 65536)
#: Scores held at a time.
SCORES = 1 << 21

_PAIR = "anchor long, score long, id long"


def prepared(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, id, label, v, norm, anchor) of the rows that take part, components as floor(scale * x)."""
    x = F.col(embedding)
    ok = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(ok).where(finite).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"),
    )
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*", norm.alias("norm")), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of a column, with zeros after shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Voronoi:
    """Cells of rows around pivots, and groups of the pivots' cells for anchors."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark = rows, rows.sparkSession
        size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("norm").alias("norm"), F.max(F.size("v")).alias("width")).first()
        self.n, self.anchors, self.most, self.width = size["n"], size["anchors"], size["norm"] or 0.0, size["width"] or 0
        if self.most >= 2.0**53:
            raise ValueError("vectors too long for exact products")
        self.slack = 1e-6 * (1 + math.sqrt(self.most))
        wanted = min(PIVOTS, max(4, math.isqrt(self.n) // 4))
        chosen = rows.orderBy(F.xxhash64("id", "v"), "id", "row").limit(wanted).select("v").collect()  # PIVOTS rows at most
        pivots = np.zeros((len(chosen), self.width))
        for i, r in enumerate(chosen):
            pivots[i, : len(r["v"])] = r["v"]
        self.pivots = np.column_stack((pivots, np.sqrt(np.maximum(0, self.most - (pivots**2).sum(1)))))
        square = np.maximum(0, 2 * self.most - 2 * self.pivots @ self.pivots.T)
        self.gaps = np.sqrt(square)
        np.fill_diagonal(self.gaps, 0)
        self.part = min(PART[1], max(PART[0], -(-self.n // 16)))
        self.salts = max(1, -(-self.n // self.part))

    def cells(self) -> DataFrame:
        """Adds cell and dist, and for anchors own_cell and own_dist."""
        pivots, most, width = self.pivots, self.most, self.width

        def run(batches):
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.slice(lo, 4096)
                    x, norm = matrix(part.column("v"), width), part.column("norm").to_numpy()
                    anchor = part.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
                    dot = x @ pivots[:, :-1].T
                    new = []
                    for square in (2 * most - 2 * (dot + np.sqrt(np.maximum(0, most - norm))[:, None] * pivots[:, -1]), norm[:, None] + most - 2 * dot):
                        cell = square.argmin(1)
                        new += [cell.astype(np.int32), np.sqrt(np.maximum(0, square[np.arange(len(cell)), cell]))]
                    mask = ~anchor
                    columns = [pa.array(c) for c in new[:2]] + [pa.array(c, mask=mask) for c in new[2:]]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "cell", "dist", "own_cell", "own_dist"])

        schema = "row long, id long, label long, anchor boolean, v array<long>, norm double, cell int, dist double, own_cell int, own_dist double"
        return written(self.rows.mapInArrow(run, schema), "cells")

    def pairs(self) -> DataFrame:
        """(own_cell, cell, gap, grp): distances between pivots, and the group of own_cell; PIVOTS**2 rows at most."""
        n = len(self.pivots)
        groups = min(n, max(1, -(-self.anchors // ANCHORS)))
        seeds = [0]
        while len(seeds) < groups:  # each next seed farthest from those there are
            seeds.append(int(self.gaps[seeds].min(0).argmax()))
        of = self.gaps[seeds].argmin(0)
        data = [(i, j, float(self.gaps[i, j]), int(of[i])) for i in range(n) for j in range(n)]
        return self.spark.createDataFrame(data, "own_cell int, cell int, gap double, grp int")


def _sent(rows: DataFrame, anchors: DataFrame, ranges: DataFrame, v: Voronoi, keys: list[str], local, schema: str) -> DataFrame:
    """What ``local`` gives for each block of anchors and each part of the rows that may serve it.

    ``ranges``: keys, own_cell, cell, grp, lo, hi; ``anchors`` have keys and grp.
    """
    by = [*keys, "grp"]
    blocks = anchors.groupBy(*by).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("blocks"))
    targets = ranges.groupBy(*by, "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(blocks, by)
    salt = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(v.salts)).cast("int").alias("salt")
    left = anchors.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(v.salts - 1))).alias("salt"), *(F.col(k).alias(f"at_{k}") for k in by)).drop("blocks", "own_cell")
    right = rows.join(targets, [*keys, "cell"]).where("dist BETWEEN lo AND hi")
    right = right.select(*(F.col(k).alias(f"to_{k}") for k in by), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"), salt.alias("to_salt"), "row", "id", "label", "v")
    left_by, right_by = [*(f"at_{k}" for k in by), "block", "salt"], [*(f"to_{k}" for k in by), "to_block", "to_salt"]
    right = right.toDF(*right.columns)  # columns of its own
    return left.groupBy(*left_by).cogroup(right.groupBy(*right_by)).applyInArrow(local, schema)


def _products(anchors: pa.Table, rows: pa.Table, width: int):
    """(from anchor, to anchor, exact products with all rows), a stripe of anchors at a time."""
    a, x = matrix(anchors["v"], width), matrix(rows["v"], width)
    step = max(1, SCORES // max(1, len(x)))
    for lo in range(0, len(a), step):
        yield lo, min(len(a), lo + step), np.rint(a[lo : lo + step] @ x.T)


def _first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row above minus infinity, of equal ones the first columns."""
    n = scores.shape[1]
    if n <= k:
        at = np.broadcast_to(np.arange(n), scores.shape)
    elif np.abs(scores, where=np.isfinite(scores), out=np.zeros_like(scores)).max(initial=0) * n < 2.0**51:
        at = np.argpartition(scores * n - np.arange(n), n - k, axis=1)[:, -k:]  # whole numbers, none twice
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), at.shape[1])
    at = at.ravel()
    there = scores[row, at] > -np.inf
    return row[there], at[there]


def positives(cells: DataFrame, v: Voronoi, k: int) -> DataFrame:
    """(anchor, no, id, score): the first k other rows with the label of each anchor (``anchor``: its row)."""
    pairs = v.pairs()
    grp = pairs.select("own_cell", "grp").distinct()
    anchors = cells.where("anchor").join(F.broadcast(grp), "own_cell").select("row", "label", "own_cell", "grp", "v", "own_dist")
    near = cells.select("label", "cell", "dist", F.row_number().over(Window.partitionBy("label", "cell").orderBy("dist")).alias("no")).where(F.col("no") <= k + 1)
    own = anchors.groupBy("label", "own_cell").agg(F.max("own_dist").alias("radius"))
    reach = own.join(near, "label").join(F.broadcast(pairs), ["own_cell", "cell"]).select("label", "own_cell", (F.col("radius") + F.col("gap") + F.col("dist")).alias("far"))
    reach = reach.withColumn("no", F.row_number().over(Window.partitionBy("label", "own_cell").orderBy("far"))).where(F.col("no") == k + 1).drop("no")
    own = own.join(reach, ["label", "own_cell"], "left").withColumn("wide", F.col("radius") + F.coalesce("far", F.lit(float("inf"))) + F.lit(v.slack))
    ranges = own.join(F.broadcast(pairs), "own_cell").select("label", "grp", "cell", (F.col("gap") - F.col("wide")).alias("lo"), (F.col("gap") + F.col("wide")).alias("hi"))
    width = v.width

    def local(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        own, number, ids, out = anchors["row"].to_numpy(), rows["row"].to_numpy(), rows["id"].to_numpy(), []
        for lo, hi, score in _products(anchors, rows, width) if len(rows) else ():
            r, c = _first(np.where(number == own[lo:hi, None], -np.inf, score), k)
            out.append((own[lo + r], score[r, c].astype(np.int64), ids[c]))
        return _table(out)

    found = _sent(cells.select("row", "id", "label", "v", "cell", "dist"), anchors.drop("own_dist"), ranges, v, ["label"], local, _PAIR)
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    return found.withColumn("no", F.row_number().over(w)).where(F.col("no") <= k)


def _table(out: list[tuple], names=("anchor", "score", "id")) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def mine(rows: DataFrame, n_positive: int = 5, n_negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` as ``prepared`` gives them.  For each anchor and each of its first
    ``n_positive`` positives, the first ``n_negative`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    v = Voronoi(rows)
    if not v.anchors:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = v.cells()
    found = written(positives(cells, v, n_positive), "positives")
    hundredth = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")  # noqa: E731  rounded down
    ask = found.select("anchor", "no", (-hundredth(f"(-{low}L * score)")).alias("least"), hundredth(f"({high}L * score)").alias("most")).where("least <= most")
    windows = ask.groupBy(F.col("anchor").alias("of")).agg(F.collect_list(F.struct("no", "least", "most")).alias("windows"), F.min("least").alias("least"), F.max("most").alias("most"))
    pairs = v.pairs()
    grp = pairs.select("own_cell", "grp").distinct()
    anchors = cells.where("anchor").join(windows, F.col("row") == F.col("of"))
    anchors = anchors.select("row", "label", "own_cell", "own_dist", "norm", "v", "windows", "least", "most").join(F.broadcast(grp), "own_cell")
    away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(v.most) - 2 * F.col(score)))
    own = anchors.groupBy("own_cell").agg(F.max("own_dist").alias("radius"), F.max(away("least")).alias("far"), F.min(away("most")).alias("near"))
    wide = F.col("radius") + F.col("far") + F.lit(v.slack)
    inside = F.col("near") - F.col("gap") - F.col("radius") - F.lit(v.slack)  # nearer rows score too high for every anchor
    ranges = own.join(F.broadcast(pairs), "own_cell").select("grp", "cell", F.greatest(F.col("gap") - wide, inside).alias("lo"), (F.col("gap") + wide).alias("hi"))
    width = v.width

    def local(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        own, labels = anchors["row"].to_numpy(), anchors["label"].to_numpy()
        other, ids, out = rows["label"].to_numpy(), rows["id"].to_numpy(), []
        asked = [sorted((w["no"], w["least"], w["most"]) for w in x) for x in anchors["windows"].to_pylist()]
        for lo, hi, score in _products(anchors, rows, width) if len(rows) else ():
            score[other == labels[lo:hi, None]] = -np.inf  # within no window
            for slot in range(max(map(len, asked[lo:hi]))):
                no, least, most = (np.array([x[slot][i] if slot < len(x) else (0, 1, 0)[i] for x in asked[lo:hi]], np.int64) for i in range(3))
                r, c = _first(np.where((score >= least[:, None]) & (score <= most[:, None]), score, -np.inf), n_negative)
                out.append((own[lo + r], no[r], score[r, c].astype(np.int64), ids[c]))
        return _table(out, ("anchor", "no", "score", "id"))

    schema = "anchor long, no long, score long, id long"
    sent = _sent(cells.select("row", "id", "label", "v", "cell", "dist"), anchors.drop("own_dist", "norm", "least", "most"), ranges, v, [], local, schema)
    w = Window.partitionBy("anchor", "no").orderBy(F.desc("score"), "id")
    first = sent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negative)
    first = first.select("anchor", "no", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = found.select("anchor", F.col("no").cast("long").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = cells.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = first.join(positive, ["anchor", "no"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
