"""Candidates as overlays: start, apply, abort and undo without copying what does not change.

A delta says what becomes of rows by their key: ``_op`` is "put", with the whole
row, or "drop".  A candidate is a base and its deltas, merged when it is read; an
undo is one more delta, the reverse of one that was applied.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources.shared import checkpointed


def _on(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_{k}"]) for k in keys))


def _keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()


def overlaid(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The base with the delta merged in; a delta has each key once."""
    gone = _keys(delta, keys)
    kept = base.join(gone, _on(base, gone, keys), "left_anti")
    return kept.unionByName(delta.where("_op = 'put'").drop("_op"))


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What turns one table into the other; keys are unique in both."""
    put = after.select(*before.columns).exceptAll(before).withColumn("_op", F.lit("put"))
    left = _keys(after, keys)
    drop = before.join(left, _on(before, left, keys), "left_anti").withColumn("_op", F.lit("drop"))
    return put.unionByName(drop)


def reverse(base: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """The delta that takes ``change`` back from the base with it."""
    touched, held = _keys(change, keys), _keys(base, keys)
    back = base.join(touched, _on(base, touched, keys), "left_semi").withColumn("_op", F.lit("put"))
    new = change.where("_op = 'put'").join(held, _on(change, held, keys), "left_anti").withColumn("_op", F.lit("drop"))
    return back.unionByName(new.select(*back.columns))


@dataclass
class Session:
    """A candidate over a live table: changes are applied one on another, and the last can be undone."""

    live: DataFrame
    keys: list[str]
    applied: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)  # each change and its reverse

    def candidate(self) -> DataFrame:
        return reduce(lambda rows, change: overlaid(rows, change[0], self.keys), self.applied, self.live)

    def apply(self, change: DataFrame) -> None:
        """One more delta; it and its reverse are written, so neither is worked out twice."""
        repeated = change.groupBy(*self.keys).agg(F.count("*").alias("n")).where("n > 1")
        if not repeated.isEmpty():
            raise ValueError("a change has each key once")
        change = checkpointed(change)
        self.applied.append((change, checkpointed(reverse(self.candidate(), change, self.keys))))

    def undo(self) -> DataFrame:
        """Takes the last change back, and returns the delta that does so."""
        if not self.applied:
            raise ValueError("nothing was applied")
        return self.applied.pop()[1]

    def abort(self) -> None:
        self.applied.clear()

    def changes(self) -> DataFrame:
        """All changes in one delta against the live table."""
        return delta(self.live, self.candidate(), self.keys)


def pending(live: DataFrame, stations: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, station, change, verdict) of what waits in each station (a delta): added, changed or removed.

    The verdict is "clash" where another station leaves the same key otherwise,
    "same" where one leaves it alike, "stale" where the live row says so already,
    else "ready".
    """
    held = live.select(*(F.col(k).alias(f"_{k}") for k in keys), F.xxhash64(F.to_json(F.struct(*sorted(live.columns)))).alias("_now"))
    parts = []
    for name, d in stations.items():
        end = F.when(F.col("_op") == "put", F.xxhash64(F.to_json(F.struct(*sorted(live.columns)))))
        parts.append(d.select(*keys, F.lit(name).alias("station"), "_op", end.alias("_end")))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.join(held, _on(rows, held, keys), "left").drop(*(f"_{k}" for k in keys))
    change = F.when(F.col("_op") == "drop", "removed").when(F.col("_now").isNull(), "added").otherwise("changed")
    rows = rows.withColumn("change", change)
    ends = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count_distinct("station").alias("_n"), F.count_distinct(F.coalesce(F.col("_end"), F.lit(0))).alias("_ends"))
    rows = rows.join(ends, _on(rows, ends, keys))
    stale = F.col("_end").eqNullSafe(F.col("_now"))
    verdict = F.when(F.col("_ends") > 1, "clash").when(stale, "stale").when(F.col("_n") > 1, "same").otherwise("ready")
    return rows.select(*keys, "station", "change", verdict.alias("verdict"))
