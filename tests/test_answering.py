"""Questions that name nothing exactly."""

from pyspark.sql import functions as F

from kgspark.operators import answering, retrieval
from kgspark.operators.graph import KnowledgeGraph


def test_close_by_text_without_scores(spark, monkeypatch):
    """Whether a question is near any name is read from distinct words, not from a score for each question and node."""

    def refused(*args):
        raise AssertionError("scored")

    none = F.lit(None).cast("string")
    monkeypatch.setattr(retrieval, "bm25", refused)
    monkeypatch.setattr(retrieval, "_bm25", refused, raising=False)
    n = spark.createDataFrame([("n1", "north road", "current"), ("n2", "the hill", "current")], "id string, label string, status string")
    nodes = n.select("*", *(none.alias(c) for c in ("valid_from", "valid_to", "superseded_by", "source_doc")), F.array().cast("array<string>").alias("sources"))
    g = KnowledgeGraph(nodes, spark.createDataFrame([], "src string, rel string, dst string, status string"))
    asked = [("a", None, "nobody on the road"), ("b", None, "the valley"), ("c", None, "North Road"), ("d", None, "the")]
    questions = spark.createDataFrame(asked, "question_id string, question string, entity string").select("*", none.alias("type"), none.alias("as_of"))
    found = answering.answers(g, questions, ["graph"]).select("question_id", "resolved_entity", "match").collect()
    assert sorted(tuple(r) for r in found) == [("a", None, "text"), ("b", None, None), ("c", "n1", "label"), ("d", None, "text")]
