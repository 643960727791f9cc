"""Versions of facts: as-of slices, supersession chains, hand-over of dates, change between two days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.expressions import valid_on
from kgspark.sources.shared import checkpointed


def as_of(rows: DataFrame, day: str) -> DataFrame:
    return rows.where(valid_on(day))


def chain(nodes: DataFrame) -> DataFrame:
    """(id, head, steps): the newest version that each node's superseded_by leads to.

    Pointers are doubled, so the rounds grow with the logarithm of the longest
    chain.  Nodes on or leading into a loop have a null head.
    """
    at = checkpointed(nodes.select("id", F.col("superseded_by").alias("next")))
    known = at.select(F.col("id").alias("_k"))
    # A pointer to an unknown node ends the chain at its holder.
    at = at.join(known, at["next"] == known["_k"], "left").select("id", F.col("_k").alias("next"), F.when(F.col("_k").isNotNull(), 1).otherwise(0).cast("long").alias("steps"))
    at = at.withColumn("at", F.coalesce("next", "id"))
    n = at.count()
    rounds = max(1, n.bit_length())
    for _ in range(rounds):
        step = at.select(F.col("id").alias("_i"), F.col("at").alias("_to"), F.col("steps").alias("_n"))
        moved = at.join(step, at["at"] == step["_i"]).select("id", "next", (F.col("steps") + F.col("_n")).alias("steps"), F.col("_to").alias("_at"), F.col("at").alias("_was"))
        moved = checkpointed(moved)
        still = moved.where("_at != _was").isEmpty()
        at = moved.select("id", "next", "steps", F.col("_at").alias("at"))
        if still:
            break
    ends = at.where("next IS NULL").select(F.col("id").alias("_e"))
    return at.join(ends, at["at"] == ends["_e"], "left").select("id", F.col("_e").alias("head"), F.when(F.col("_e").isNotNull(), F.col("steps")).alias("steps"))


def history(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, older): what superseded itself into the id, or the id says that it supersedes."""
    wanted = ids.select("id").distinct()
    back = nodes.select(F.col("superseded_by").alias("id"), F.col("id").alias("older")).where("id IS NOT NULL")
    if "supersedes" in nodes.columns:
        back = back.union(nodes.select("id", F.explode("supersedes")))
    return back.join(wanted, "id", "left_semi").distinct()


def handed_over(rows: DataFrame, chain_col: str = "chain", start: str = "valid_from", key: str = "id") -> DataFrame:
    """Adds next_from, the start of the next version of the same chain (null for the newest)."""
    w = Window.partitionBy(chain_col).orderBy(start, key)
    return rows.withColumn("next_from", F.lead(start).over(w))


def broken_handover(nodes: DataFrame) -> DataFrame:
    """(id, valid_to, successor, successor_from): versions whose end is not their successor's beginning."""
    succ = nodes.select(F.col("id").alias("successor"), F.col("valid_from").alias("successor_from"))
    out = nodes.join(succ, nodes["superseded_by"] == succ["successor"])
    return out.where("valid_to IS NOT NULL AND successor_from IS NOT NULL AND valid_to != successor_from").select("id", "valid_to", "successor", "successor_from")


def status_on(rows: DataFrame, day: str, chain_col: str = "chain") -> DataFrame:
    """(chain, version, status): the version valid on a day; status is found, ambiguous or absent."""
    ok = valid_on(day)
    n = F.count_if(ok)
    return rows.groupBy(chain_col).agg(
        F.when(n == 1, F.max(F.when(ok, F.col("id")))).alias("version"),
        F.when(n == 0, "absent").when(n == 1, "found").otherwise("ambiguous").alias("status"),
    )


def change(rows: DataFrame, before: str, after: str, chain_col: str = "chain", value: str = "value") -> DataFrame:
    """(chain, change): changed, unchanged, appeared, ended or absent between two days."""

    def at(day, name):
        return F.max_by(F.when(valid_on(day), F.col(value)), F.when(valid_on(day), F.col("valid_from"))).alias(name), F.max(valid_on(day)).alias(f"{name}_there")

    by = rows.groupBy(chain_col).agg(*at(before, "a"), *at(after, "b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    verdict = (
        F.when(F.col("a_there") & F.col("b_there"), F.when(same, "unchanged").otherwise("changed"))
        .when(F.col("a_there"), "ended")
        .when(F.col("b_there"), "appeared")
        .otherwise("absent")
    )
    return by.select(chain_col, verdict.alias("change"))


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each key; ties go to the row that is largest as a whole."""
    cols = rows.columns
    return rows.groupBy(by).agg(F.max_by(F.struct(*cols), F.struct(order, *(c for c in cols if c not in (by, order)))).alias("r")).select("r.*")


def audit_chain(log: DataFrame, order: str = "seq", payload: str = "payload") -> DataFrame:
    """Rows of a hash-chained log with ``broken``: the hash is not that of the row and the hash before.

    The row before is found by an equi-join on the sequence number, so a log of
    any length has no single-task sort.  A gap in the numbers is a break too.
    """
    prev = log.select((F.col(order) + 1).alias("_seq"), F.col("hash").alias("_prev"))
    out = log.join(prev, log[order] == prev["_seq"], "left")
    want = F.sha2(F.concat_ws("|", F.coalesce("_prev", F.lit("")), F.col(order).cast("string"), payload), 256)
    return out.withColumn("broken", F.col("hash") != want).drop("_seq", "_prev")
