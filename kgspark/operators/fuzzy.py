"""Substrings both ways between two tables of texts, through an index of grams.

``a LIKE %b%`` for all pairs of two tables is a comparison of every row with
every row.  Here the shorter text is filed under one gram, the rarest of its own
among the longer ones' texts, and a longer text is looked up under each of its
grams: an equi-join, whose hits are verified.  Any text that contains the other
has all its grams, so none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.sources.shared import checkpointed

#: Characters of a gram; a shorter text is a gram by itself.
Q = 3
#: A gram that more short texts are filed under is spread over this many keys for each of so many.
SPREAD = 1000


def grams(text: Column, n: int = Q) -> Column:
    """The distinct grams of n characters, or none."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short_id, long_id): texts of ``short`` (short_id, t) that stand in texts of ``long`` (long_id, t), case aside for A to Z.

    Empty and null texts stand in none.
    """
    low = F.translate(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    short = checkpointed(short.select("short_id", low.alias("s")).where("s <> ''").distinct())
    long = long.select("long_id", low.alias("l")).where("l <> ''").distinct()
    texts = short.select("s").distinct()
    whole = lambda c: F.when(F.length(c) < Q, F.array(c)).otherwise(grams(c))
    asked = texts.select("s", F.explode(whole(F.col("s"))).alias("g"))
    sizes = [r[0] for r in texts.select(F.least(F.length("s"), F.lit(Q)).alias("n")).distinct().collect()]  # Q numbers at most
    every = [grams(F.col("l"), n) for n in sizes]
    looked = long.select("long_id", "l", F.explode(F.array_distinct(F.concat(*every)) if every else F.array().cast("array<string>")).alias("g"))
    looked = looked.join(asked.select("g").distinct(), "g", "left_semi")
    often = looked.groupBy("g").agg(F.count("*").alias("n"))
    # Of the grams that long texts have at all, the rarest there; a text with a gram that none has stands in none.
    filed = asked.join(often, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    filed = filed.withColumn("no", F.row_number().over(Window.partitionBy("s").orderBy("n", "g"))).where("no = 1 AND n > 0").select("s", "g")
    keys = filed.groupBy("g").agg((F.floor(F.count("*") / SPREAD) + 1).cast("int").alias("keys"))
    filed = filed.join(keys, "g").withColumn("key", F.pmod(F.xxhash64("s"), F.col("keys")).cast("int")).drop("keys")
    looked = looked.join(keys, "g").withColumn("key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))).drop("keys")
    hits = filed.join(looked, ["g", "key"]).where(F.contains("l", F.col("s"))).select("s", "long_id").distinct()
    return hits.join(short, "s").select("short_id", "long_id").distinct()


def lexicon_fuzzy(lexicon: DataFrame, terms: DataFrame, limit: int | None = 80) -> DataFrame:
    """(term, canonical, target, status, note) of phrases that stand in a term, or that a term stands in.

    ``limit`` rows for each term (the lookup's answer), by canonical, target,
    status and note; none: all.  Wildcards of LIKE in a phrase are letters here.
    """
    rows = lexicon.select(F.col("phrase").alias("id"), F.col("phrase").alias("t")).distinct()
    asked = terms.select(F.col("term").alias("id"), F.col("term").alias("t")).distinct()
    name = lambda df, x: df.withColumnRenamed("id", x)
    within = contained(name(rows, "short_id"), name(asked, "long_id")).select(F.col("long_id").alias("term"), F.col("short_id").alias("phrase"))
    around = contained(name(asked, "short_id"), name(rows, "long_id")).select(F.col("short_id").alias("term"), F.col("long_id").alias("phrase"))
    found = within.union(around).distinct().join(lexicon.select("phrase", "canonical", "target", "status", "note"), "phrase").drop("phrase").distinct()
    if limit is None:
        return found
    w = Window.partitionBy("term").orderBy("canonical", "target", "status", "note")
    return found.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= limit).drop("_no")
