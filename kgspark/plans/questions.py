"""Questions over a graph: run one, survey one over all its subjects, and briefs of several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.plans.pattern import Matcher

#: (gate, has rows): status.
STATUSES = {
    ("non_empty", True): "answered", ("non_empty", False): "unanswered",
    ("empty", True): "violated", ("empty", False): "clean",
    ("no_gaps", True): "answered", ("no_gaps", False): "unanswered",
    ("none", True): "answered", ("none", False): "empty",
}
BLOCKING = ("unanswered", "violated")


def _renamed(patterns: list[dict], declared) -> list[dict]:
    """``$NAME`` in the place of a variable, where NAME is a parameter, as the variable NAME."""

    def one(x):
        if isinstance(x, str) and x.startswith("$") and x[1:] in declared:
            return x[1:]
        return x

    out = []
    for p in patterns:
        p = dict(p)
        for key in ("node", "not_node"):
            if isinstance(p.get(key), str):
                p[key] = one(p[key])
        for key in ("edge", "not_edge"):
            if key in p:
                p[key] = [one(p[key][0]), p[key][1], one(p[key][2])]
        for key in ("optional", "not"):
            if key in p:
                p[key] = _renamed(p[key], declared)
        out.append(p)
    return out


def answers(matcher: Matcher, question: dict, params: dict[str, str] | None = None) -> DataFrame:
    """The rows of one question, its parameters bound to node ids."""
    ask, declared = question["ask"], question.get("params") or {}
    return matcher.select(matcher.match(_renamed(ask["when"], declared), matcher.start(params)), ask["select"])


def gaps(matcher: Matcher, question: dict, params: dict[str, str] | None = None) -> DataFrame:
    """(say, subject): what the question's gap patterns find."""
    declared = question.get("params") or {}
    parts = []
    for g in question.get("gaps") or []:
        found = matcher.match(_renamed(g["when"], declared), matcher.start(params))
        subject = next((c for c in found.columns if not c.startswith("_")), None)
        column = F.col(subject) if subject else F.lit(None).cast("string")
        parts.append(found.select(F.lit(g.get("say") or "").alias("say"), column.alias("subject")).distinct())
    if not parts:
        return matcher.spark.createDataFrame([], "say string, subject string")
    return reduce(DataFrame.union, parts)


def status(matcher: Matcher, question: dict, params: dict[str, str] | None = None) -> str:
    gate = question.get("gate", "non_empty")
    out = STATUSES[gate, not answers(matcher, question, params).isEmpty()]
    if gate == "no_gaps" and not gaps(matcher, question, params).isEmpty():
        return "unanswered"
    return out


def survey(matcher: Matcher, question: dict) -> DataFrame:
    """(subject, n_rows, status) for every entity that the first parameter can stand for.

    One plan for all subjects: the parameter is left free and answers are
    counted by it.
    """
    declared = question["params"]
    first = next(iter(declared))
    gate = question.get("gate", "non_empty")
    subjects = matcher.match([{"node": first, "type": declared[first].get("type")}]).select(first).distinct()
    ask = question["ask"]
    found = matcher.match(_renamed(ask["when"], declared), subjects)
    rows = matcher.select(found, [f"${first}", *(s for s in ask["select"] if s.lstrip("$") != first)])
    n = rows.groupBy(F.col(first).alias("_s")).agg(F.count("*").alias("n_rows"))
    out = subjects.join(n, subjects[first] == n["_s"], "left").select(F.col(first).alias("subject"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    verdict = F.when(F.col("n_rows") > 0, STATUSES[gate, True]).otherwise(STATUSES[gate, False])
    if gate == "no_gaps":
        for g in question.get("gaps") or []:
            hit = matcher.match(_renamed(g["when"], declared), subjects).select(F.col(first).alias("_g")).distinct()
            out = out.join(hit.withColumn("_hit", F.lit(True)), out["subject"] == hit["_g"], "left").drop("_g")
            out = out.withColumn("_gap", F.coalesce("_hit", F.lit(False)) | (F.col("_gap") if "_gap" in out.columns else F.lit(False))).drop("_hit")
        if "_gap" in out.columns:
            verdict = F.when(F.col("_gap"), "unanswered").otherwise(verdict)
    return out.withColumn("status", verdict).select("subject", "n_rows", "status")


def summary(surveyed: DataFrame) -> DataFrame:
    """One row: asked, answered, and unanswered or violated subjects."""
    return surveyed.agg(
        F.count("*").alias("asked"), F.count_if(F.col("n_rows") > 0).alias("answered"), F.count_if(F.col("status").isin(*BLOCKING)).alias("blocking")
    )


def brief(matcher: Matcher, required: dict[str, dict], optional: dict[str, dict] | None = None) -> DataFrame:
    """(subject, status, blocking): READY where no required question blocks, else BLOCKED and by which.

    All questions share their first parameter's class.
    """
    parts = []
    for must, group in ((True, required), (False, optional or {})):
        for qid, q in group.items():
            parts.append(survey(matcher, q).select("subject", F.lit(qid).alias("question"), (F.lit(must) & F.col("status").isin(*BLOCKING)).alias("blocks")))
    rows = reduce(DataFrame.union, parts)
    by = rows.groupBy("subject").agg(F.array_sort(F.collect_set(F.when(F.col("blocks"), F.col("question")))).alias("blocking"))
    return by.select("subject", F.when(F.size("blocking") > 0, "BLOCKED").otherwise("READY").alias("status"), "blocking")
