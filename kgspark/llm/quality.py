"""Quality rules with robust multivariate outliers.

Word, symbol, line and repetition statistics of each whole text; fixed base
rules; then, for each language and source, a minimum-covariance-determinant
estimate of centre and scatter of transformed statistics, and rejection by
Mahalanobis distance.

The estimate is found by concentration steps on Spark.  The first half set is
that nearest the coordinate-wise medians; each step fits mean and covariance to
the half set and takes the half nearest to the fit.  A step bins the squared
distances and sums, for each group and bin, fixed-point values and their
products as integers; a group's half set is the lowest bins that hold half its
rows (the last bin whole).  So a step is one partial aggregation whose result is
bounded by groups times bins, no group's rows meet in one task, and results do
not depend on partitions.  A group takes a step only if that lowers the
determinant of its (floored) scatter by a thousandth, and the steps end when no
group does; as floors bound determinants from below, they end.

Statistics that hardly vary within a group would make the scatter singular, so
the scatter has a floor: with each statistic in units of its ``FLOORS``, no
direction's variance is taken as less than one.  Larger variances stay as they
are.  Smaller differences of a statistic do not count as signs of bad text.  The distance is to the reweighted
estimate: mean and scatter of the rows within the 97.5 % quantile of the first.

Defined results: null and word-less text fails the base rules; a null language
or source is a group of its own; only rows that pass the base rules enter
estimates; groups with fewer than ``min_rows`` of those are judged by the
estimate of all rows of their language, or of all rows where that has too few;
repeated rows count and are judged each; other columns stay as they are,
whatever their names, but those that are added replace columns of that name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.shared import checkpointed, written
from kgspark.llm.text import _SPACE, chunks, mix, sums, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Fixed point of transformed statistics.
SCALE = 1024
#: Of ln mean word length, ln words, and ln(1 + 100 x) of the shares of symbols, repeated lines, and repeated words.
FLOORS = (0.10, 0.5, 0.5, 0.5, 0.5)
P = len(FLOORS)


def chi2_above(x: float) -> float:
    """Share of a chi-square variable with five degrees of freedom above x."""
    return math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def chi2_quantile(above: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if chi2_above((lo + hi) / 2) > above else (lo, (lo + hi) / 2)
    return hi


def consistency(share: float) -> float:
    """What makes the scatter of the nearest ``share`` of normal rows that of all."""
    q = chi2_quantile(1 - share)
    seven = 1 - chi2_above(q) - math.sqrt(2 * q / math.pi) * math.exp(-q / 2) * q * q / 15
    return share / seven


#: Rows of normal data beyond the cut: one in ten thousand.
CHI2_CUT = chi2_quantile(1e-4)
#: Bins for each doubling of the distance.
FINE = 16
#: What a step has to take from the logarithm of a determinant.
GAIN = 1e-3
#: How many of the columns of a group its estimate tells apart.
DEPTH = "_depth"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _statistics(words) -> tuple[np.ndarray, ...]:
    data, offsets, counts = words.data, words.offsets, words.counts
    inside = ~_SPACE[data]
    chars = sums(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = sums(_SYMBOL[data], offsets)
    # Lines: between line feeds and the edges of documents.
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1], feeds + 1))
    ends = np.concatenate((feeds, offsets[1:]))
    starts.sort()
    ends.sort()
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=held[1:])
    full = held[ends] > held[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(offsets, starts, "right") - 1
    body = data.tobytes()
    lines = np.array([xxhash.xxh64_intdigest(body[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    lines = mix(lines + doc.astype(np.uint64))
    n = len(offsets) - 1
    _, first = np.unique(lines, return_index=True)
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # Words covered by repeated windows.
    repeated = np.zeros(n, np.int64)
    at = words.windows(WINDOW)
    if len(at):
        owner = words.owner()
        keys = mix(window_hashes(words.hashes(), WINDOW)[at] + owner[at].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(owner) + 1, np.int64)
        edge[at[twice]] += 1
        edge[at[twice] + WINDOW] -= 1  # starts are distinct, and so are ends
        repeated = words.per_doc(np.cumsum(edge)[:-1] > 0)
    return counts, chars, symbols, dup, repeated


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five statistics and base_failed to every row; the text itself is left out."""
    keep = [c for c in docs.columns if c not in (text, *STATS)]
    docs = docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            parts = [_statistics(words) for _, _, words in chunks(batch.column(len(keep)))]
            found = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)] or [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*keep, *STATS])

    fields = [*docs.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in STATS)]
    out = docs.mapInArrow(run, T.StructType(fields))
    return out.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _fixed(x):
    return F.round(x * SCALE).cast("long")


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0 to x4, the transformed statistics in fixed point (for rows with words)."""
    words = F.greatest("n_words", F.lit(1))
    share = lambda c: F.log1p(100 * F.col(c) / words)
    xs = [F.log(F.greatest("word_chars", F.lit(1)) / words), F.log(words), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]
    return stats.withColumns({f"x{i}": _fixed(x) for i, x in enumerate(xs)})


def _distance(centre: str = "centre", precision: str = "precision"):
    """Squared Mahalanobis distance from the fitted columns."""
    d = [(F.col(f"x{i}") - F.col(centre)[i]) / SCALE for i in range(P)]
    terms = [d[i] * d[j] * F.col(precision)[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _moments() -> list:
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    return [
        F.count("*").alias("n"),
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in pairs),
    ]


def _fit(n: int, row: pd.Series, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre (in fixed point), inverse of the floored scatter and logarithm of its determinant (in floors), from summed moments."""
    mean = np.array([int(row[f"s{i}"]) / n for i in range(P)])
    cov = np.zeros((P, P))
    for i in range(P):
        for j in range(i, P):
            # exact integers before the one division, so no digits cancel
            cov[i, j] = cov[j, i] = (int(row[f"p{i}{j}"]) * n - int(row[f"s{i}"]) * int(row[f"s{j}"])) / n / n / SCALE**2
    unit = np.outer(FLOORS, FLOORS)
    variance, axes = np.linalg.eigh(cov * factor / unit)
    variance = np.maximum(variance, 1)
    return mean, (axes / variance) @ axes.T / unit, float(np.log(variance).sum())


def outliers(rows: DataFrame, by: tuple[str, ...] = ("lang", "source"), min_rows: int = 20) -> DataFrame:
    """(*by, centre, precision, logdet) of each group with at least ``min_rows`` rows of x0 to x4, or of depth 0."""
    keys = [F.col(c) for c in by]
    params = "centre array<double>, precision array<double>, logdet double"
    schema = T.StructType([rows.schema[c] for c in by] + T._parse_datatype_string(params).fields)

    def joined(fits: DataFrame) -> DataFrame:
        return rows.join(fits, _same(rows, fits, by)).drop(*(f"_{c}" for c in by))

    def named(fits: DataFrame) -> DataFrame:
        for c in by:
            fits = fits.withColumnRenamed(c, f"_{c}")
        return fits

    # Medians and median absolute deviations, from counts by value on a coarse fixed grid.
    step = SCALE // 32
    grid = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") / step).alias("v")) for i in range(P)))).alias("g"))
    grid = grid.groupBy(*by, "g.i", "g.v").count()

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, precision = np.zeros(P), np.zeros((P, P))
        for i, part in pdf.groupby("i"):
            v, c = part["v"].to_numpy(), part["count"].to_numpy()
            middle = _quantile(v, c)
            spread = _quantile(np.abs(v - middle), c)
            centre[i] = (middle + 0.5) * step
            precision[i, i] = 1 / max(1.4826 * spread * step / SCALE, FLOORS[i]) ** 2
        keep = pdf[pdf["i"] == 0]["count"].sum() >= min_rows or (DEPTH in by and pdf[DEPTH].iloc[0] == 0)
        return _row(pdf, by, centre, precision, math.inf).iloc[: int(keep)]

    fits = checkpointed(named(grid.groupBy(*by).applyInPandas(start, schema)))

    def stepped(share: float, within: float | None):
        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bin")
            if within is None:
                before = pdf["n"].cumsum() - pdf["n"]
                pdf = pdf[before < (pdf["n"].sum() + P + 2) // 2]
            total = pdf.drop(columns=list(by)).sum()
            return _row(pdf, by, *_fit(int(total["n"]), total, consistency(share)))

        return fit

    binned = F.floor(F.log2(1 + _distance()) * FINE).cast("long")
    fit = F.struct("centre", "precision", "logdet").alias("fit")
    while True:
        sums_ = joined(fits).groupBy(*by, binned.alias("bin")).agg(*_moments())
        new = sums_.groupBy(*by).applyInPandas(stepped(0.5, None), schema).select(*by, fit)
        lower = F.coalesce(new["fit.logdet"] < F.col("logdet") - GAIN, F.lit(False))
        both = fits.join(new, _same(new, fits, by), "left")
        both = both.select(*(f"_{c}" for c in by), lower.alias("lower"), F.when(lower, new["fit"]).otherwise(fit).alias("fit"))
        both = checkpointed(both)
        fits = both.select(*(f"_{c}" for c in by), "fit.*")
        if not both.where("lower").take(1):
            break
    near = joined(fits).where(_distance() <= chi2_quantile(0.025)).groupBy(*by, F.lit(0).alias("bin")).agg(*_moments())
    return named(near.groupBy(*by).applyInPandas(stepped(0.975, 0.975), schema))


def _same(rows: DataFrame, fits: DataFrame, by: tuple[str, ...]):
    cond = F.lit(True)
    for c in by:
        cond = cond & rows[c].eqNullSafe(fits[f"_{c}"])
    return cond


def _quantile(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    reach = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(reach, (reach[-1] + 1) // 2)])


def _row(pdf: pd.DataFrame, by, centre: np.ndarray, precision: np.ndarray, logdet: float) -> pd.DataFrame:
    return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "centre": [centre.tolist()], "precision": [precision.ravel().tolist()], "logdet": [logdet]})


def estimates(rows: DataFrame, by: tuple[str, ...] = ("lang", "source"), min_rows: int = 20) -> DataFrame:
    """(*by, centre, precision) of every group: its own estimate, or that of the next coarser group with enough rows.

    The last is all rows.  Coarser groups are estimated with the others, in the
    same steps, if some group needs them.
    """
    sizes = checkpointed(rows.groupBy(*by).agg(F.count("*").alias("n")))
    depths = [len(by)]
    while depths[-1] and sizes.groupBy(*by[: depths[-1]]).agg(F.sum("n").alias("n")).where(F.col("n") < min_rows).take(1):
        depths.append(depths[-1] - 1)

    def cut(depth: int):
        keys = [(F.col(c) if i < depth else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for i, c in enumerate(by)]
        return F.struct(F.lit(depth).alias(DEPTH), *keys)

    xs = [f"x{i}" for i in range(P)]
    spread = rows.select(F.explode(F.array(*(cut(d) for d in depths))).alias("g"), *xs).select("g.*", *xs)
    fits = checkpointed(outliers(spread, (DEPTH, *by), min_rows))
    out = sizes.select(*by)
    for d in depths:
        fit = fits.where(F.col(f"_{DEPTH}") == d).select(*(F.col(f"_{c}") for c in by), F.struct("centre", "precision").alias(f"fit{d}"))
        out = out.join(fit, _same(out, fit, by[:d]), "left").drop(*(f"_{c}" for c in by))
    best = F.coalesce(*(f"fit{d}" for d in depths))
    return out.select(*(F.col(c).alias(f"_{c}") for c in by), best["centre"].alias("centre"), best["precision"].alias("precision"))


def quality(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), min_rows: int = 20, cut: float = CHI2_CUT, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with the statistics, base_failed, distance2 and kept.

    distance2 is null where the base rules failed.
    """
    new = [*STATS, "base_failed", "distance2", "kept"]
    row = F.struct(*(F.col(c) for c in docs.columns if c not in (text, *new)))
    groups = [f"by{i}" for i in range(len(by))]
    rows = docs.select(row.alias("row"), *(F.col(c).alias(g) for c, g in zip(by, groups)), F.col(text).alias("text"))
    stats = written(vectors(statistics(rows)), "statistics")
    fits = estimates(stats.where("NOT base_failed").select(*groups, *(f"x{i}" for i in range(P))), tuple(groups), min_rows)
    # Written, so Spark knows its size: a small one goes to the rows, and a hot group of a large one is split.
    fits = written(fits, "estimates")
    out = stats.join(fits, _same(stats, fits, tuple(groups)), "left")
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cut)
    return out.withColumn("kept", kept).select("row.*", *new)
