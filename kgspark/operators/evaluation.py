"""Graded answers of retrieval systems: scores of each answer, means of each system, cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import metrics


def graded(results: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Results joined with their questions: outcome, citation, coverage, entity hit and temporal score of each.

    results: system, question_id, answer_kind, resolved_entity, answer_status, surfaced_sources, abstained, match;
    questions: question_id, type, expected_entities, expected_status, supporting_sources.
    """
    rows = results.join(questions, "question_id")
    rows = rows.withColumn("outcome", metrics.outcome())
    rows = rows.withColumn("citation", metrics.citation(F.col("surfaced_sources"), F.col("supporting_sources")))
    rows = rows.withColumn("coverage", metrics.coverage(F.col("surfaced_sources"), F.col("supporting_sources"), k))
    return rows.withColumn("temporal", metrics.temporal_score(F.col("answer_status"), F.col("expected_status"), F.col("type")))


def by_system(rows: DataFrame) -> DataFrame:
    """(system, asked, right, wrong, abstained, precision, coverage, score, f1)."""
    n = lambda w: F.count_if(F.col("outcome") == w)
    out = rows.groupBy("system").agg(
        F.count("*").alias("asked"), n("right").alias("right"), n("wrong").alias("wrong"), n("abstained").alias("abstained"), F.avg("citation.f1").alias("f1")
    )
    answered = F.col("right") + F.col("wrong")
    return out.withColumns(
        {
            "precision": F.when(answered > 0, F.col("right") / answered),
            "coverage": answered / F.col("asked"),
            "score": metrics.score(F.col("right"), F.col("wrong"), F.col("asked")),
        }
    )


def sweep(rows: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(system, cutoff, right, wrong, abstained): what each system's outcomes are if matches below a cut-off abstain."""
    cuts = F.explode(F.array(*(F.lit(float(c)) for c in cutoffs))).alias("cutoff")
    rows = rows.select("system", "type", "outcome", "match", cuts)
    low = F.coalesce(F.col("match") < F.col("cutoff"), F.lit(False)) & (F.col("outcome") != "abstained")
    now = F.when(low, F.when(F.col("type") == "negative", "right").otherwise("abstained")).otherwise(F.col("outcome"))
    rows = rows.withColumn("now", now)
    return rows.groupBy("system", "cutoff").agg(*(F.count_if(F.col("now") == w).alias(w) for w in ("right", "wrong", "abstained")))


def gold_problems(questions: DataFrame) -> DataFrame:
    """(question_id, problem) of a gold set: no source, repeated id, negative with an answer, temporal without a status."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    n_sources = F.coalesce(F.size("supporting_sources"), F.lit(0))
    cases = F.array(
        F.when((kind != "negative") & (n_sources <= 0), "no supporting source"),
        F.when((kind == "negative") & (F.coalesce(F.size("expected_entities"), F.lit(0)) > 0), "negative with an expected entity"),
        F.when(kind.startswith("temporal") & F.col("expected_status").isNull(), "temporal without a status"),
    )
    own = questions.select("question_id", F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("problem"))
    again = questions.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("id is used more than once"))
    return own.union(again)
