"""Answering a table of questions from the graph, all in one plan, and the systems it is compared with.

questions: question_id, question, entity (the name as asked, or null), type, as_of.

A question names entities by id, label, alias or lexicon phrase; without an
``entity`` its text is searched for names, longest first.  Of the versions found
one is picked by time; more than one entity at that time is ambiguous, and the
question stays unanswered, as it does if nothing is named exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.expressions import valid_on
from kgspark.operators.graph import KnowledgeGraph
from kgspark.operators.links import credited, names_in
from kgspark.operators.retrieval import any_entity, search
from kgspark.sources.shared import checkpointed

GRADES = {1: "id", 2: "label", 3: "alias", 4: "lexicon"}
_STRINGS = "array<string>"


def name_index(g: KnowledgeGraph) -> DataFrame:
    """(name, grade, node_id): every label, alias and lexicon phrase of two characters or more in lower case.

    All nodes of a name have the grade of the first kind that has it: label (2), alias (3), lexicon (4).
    """
    rows = g.nodes.select(F.lower(F.trim("label")).alias("name"), F.lit(2).alias("grade"), F.col("id").alias("node_id"))
    if g.aliases is not None:
        rows = rows.union(g.aliases.select(F.lower(F.trim("alias")), F.lit(3), "node_id"))
    if g.lexicon is not None:
        ingested = g.lexicon.where("target IS NOT NULL") if "status" not in g.lexicon.columns else g.lexicon.where("target IS NOT NULL AND NOT status <=> 'not_ingested'")
        rows = rows.union(ingested.select(F.lower(F.trim("phrase")), F.lit(4), "target"))
    rows = rows.where(F.length("name") > 1).groupBy("name", "node_id").agg(F.min("grade").alias("grade"))
    first = rows.groupBy("name").agg(F.min("grade").alias("grade"))
    return rows.select("name", "node_id").join(first, "name").select("name", "grade", "node_id")


def resolved(g: KnowledgeGraph, questions: DataFrame) -> DataFrame:
    """(question_id, node_id, grade): the nodes that each question names, by the best grade of each node."""
    names = checkpointed(name_index(g))
    given = questions.select("question_id", F.trim(F.coalesce("entity", F.lit(""))).alias("given")).where("given <> ''")
    by_id = given.join(g.nodes.select(F.col("id").alias("node_id")), F.col("given") == F.col("node_id")).select("question_id", "node_id", F.lit(1).alias("grade"))
    rest = given.join(by_id.select("question_id").distinct(), "question_id", "left_anti").select("question_id", F.lower("given").alias("name"))
    by_name = rest.join(names, "name").select("question_id", "node_id", "grade")
    free = questions.where("coalesce(trim(entity), '') = ''").select("question_id", "question")
    found = names_in(free, names.select("name", "node_id"), "question_id", "question").select("question_id", "node_id").distinct()
    grades = names.groupBy("node_id").agg(F.min("grade").alias("grade"))
    return reduce(DataFrame.unionByName, [by_id, by_name, found.join(grades, "node_id").select("question_id", "node_id", "grade")])


def picked(g: KnowledgeGraph, questions: DataFrame, found: DataFrame, temporal: bool = True) -> DataFrame:
    """(question_id, node_id, grade, answer_status): the version that each question is about; no node if that is ambiguous.

    With a day: the one valid then ("current"), or what exists now ("absent").
    Without: the current one, else the first by id with its own status; for a
    question of change, whether versions before or after it are known.
    """
    rows = found.join(g.nodes.select(F.col("id").alias("node_id"), "status", "valid_from", "valid_to"), "node_id").join(questions.select("question_id", "type", "as_of"), "question_id")
    if not temporal:
        first = rows.groupBy("question_id").agg(F.min_by(F.struct("node_id", "grade"), "node_id").alias("x"))
        return first.select("question_id", "x.*", F.lit("current").alias("answer_status"))
    now = F.coalesce("status", F.lit("current")) == "current"
    then = F.coalesce(valid_on(F.col("as_of")), F.lit(False)) & F.col("as_of").isNotNull()
    best = lambda order: F.min_by(F.struct("node_id", "grade", "status"), F.struct(*order, "node_id"))
    one = rows.withColumns({"now": now, "then": then}).groupBy("question_id", "type", "as_of").agg(
        F.count_if("now").alias("n_now"), F.count_if("then").alias("n_then"), best([~F.col("then"), ~F.col("now")]).alias("x"), best([~F.col("now")]).alias("y")
    )
    dated = F.col("as_of").isNotNull()
    ambiguous = F.when(dated, (F.col("n_then") > 1) | ((F.col("n_then") == 0) & (F.col("n_now") > 1))).otherwise(F.col("n_now") > 1)
    one = one.withColumn("x", F.when(dated, F.col("x")).otherwise(F.col("y"))).withColumn("ambiguous", ambiguous)
    one = one.select("question_id", "type", "as_of", "n_now", "n_then", "ambiguous", "x.*")
    older = g.nodes.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("_o")).distinct()
    newer = g.nodes.where("superseded_by IS NOT NULL").join(g.nodes.select(F.col("id").alias("_s")), F.col("superseded_by") == F.col("_s"), "left_semi").select(F.col("id").alias("_n"))
    one = one.join(older, F.col("node_id") == F.col("_o"), "left").join(newer, F.col("node_id") == F.col("_n"), "left")
    status = (
        F.when(F.col("as_of").isNotNull(), F.when(F.col("n_then") > 0, "current").otherwise("absent"))
        .when(F.col("type") == "temporal_change", F.when(F.col("_o").isNotNull() | F.col("_n").isNotNull(), "changed").otherwise("unchanged"))
        .when(F.col("n_now") > 0, "current")
        .otherwise(F.col("status"))
    )
    kept = lambda c: F.when(~F.col("ambiguous"), c)
    return one.select("question_id", kept(F.col("node_id")).alias("node_id"), kept(F.col("grade")).alias("grade"), kept(status).alias("answer_status"))


def passages_for(questions: DataFrame, passages: DataFrame | None, pages: DataFrame | None, limit: int = 10) -> DataFrame:
    """(question_id, retrieved, title): sources of the best passages by their words, each once, and the title of the first.

    passages: path, title, body; pages: path of a generated page, sources of its node.
    """
    if passages is None:
        return questions.select("question_id", F.array().cast(_STRINGS).alias("retrieved"), F.lit(None).cast("string").alias("title"))
    texts = passages.select("path", "title", F.concat_ws(" ", "title", "body").alias("text"))
    hits = search(texts, questions.select(F.col("question_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query")), "path", "text", limit)
    if pages is None:
        pages = passages.sparkSession.createDataFrame([], "path string, sources array<string>")
    sources = credited(hits, pages).select(F.col("query_id").alias("question_id"), F.col("sources").alias("retrieved"))
    first = hits.where("rank = 1").join(passages.select("path", "title"), "path").select(F.col("query_id").alias("question_id"), "title")
    out = questions.select("question_id").join(sources, "question_id", "left").join(first, "question_id", "left")
    return out.select("question_id", F.coalesce("retrieved", F.array().cast(_STRINGS)).alias("retrieved"), "title")


def from_graph(g: KnowledgeGraph, questions: DataFrame, found: DataFrame, read: DataFrame, name: str, temporal: bool = True) -> DataFrame:
    """An answer for each question; ``match`` says by what it was found, or why it was not answered (ambiguous, text)."""
    one = picked(g, questions, found, temporal)
    node = g.nodes.select(F.col("id").alias("node_id"), F.col("label").alias("answer"), "sources", "source_doc")
    cited = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("sources", F.array().cast(_STRINGS)), F.array("source_doc")))))
    one = one.join(node, "node_id", "left")
    lost = questions.join(one.select("question_id"), "question_id", "left_anti")
    asked = lost.select("question_id", F.coalesce(F.nullif(F.trim("entity"), F.lit("")), "question").alias("term"))
    close = any_entity(g.nodes, asked.where("term IS NOT NULL"))
    close = asked.join(close, "term", "left_semi").select("question_id", F.lit("text").alias("close"))
    grade = F.element_at(F.create_map(*(F.lit(x) for pair in GRADES.items() for x in pair)), F.col("grade"))
    out = questions.select("question_id").join(one, "question_id", "left").join(close, "question_id", "left").join(read, "question_id")
    cites = F.when(F.col("node_id").isNotNull(), cited).otherwise(F.array().cast(_STRINGS))
    answered = F.col("node_id").isNotNull()
    seen = one.select("question_id", F.lit(True).alias("_seen"))
    out = out.join(seen, "question_id", "left")
    return out.select(
        "question_id", F.lit(name).alias("system"), F.lit("entity").alias("answer_kind"), F.col("node_id").alias("resolved_entity"),
        F.when(answered, grade).when(F.col("_seen"), "ambiguous").otherwise(F.col("close")).alias("match"), "answer_status", (~answered).alias("abstained"), "answer",
        cites.alias("cited_sources"), F.when(answered, F.col("retrieved")).otherwise(F.array().cast(_STRINGS)).alias("retrieved_sources"),
        F.when(answered, F.array_distinct(F.concat(cites, "retrieved"))).otherwise(F.array().cast(_STRINGS)).alias("surfaced_sources"),
    )


def from_text(questions: DataFrame, read: DataFrame) -> DataFrame:
    """The baseline: it surfaces passages, cites the first three and knows nothing of time."""
    none = F.lit(None).cast("string")
    return read.select(
        "question_id", F.lit("lexical").alias("system"), F.lit("passage").alias("answer_kind"), none.alias("resolved_entity"), none.alias("match"), F.lit("unknown").alias("answer_status"),
        (F.size("retrieved") == 0).alias("abstained"), F.col("title").alias("answer"), F.slice("retrieved", 1, 3).alias("cited_sources"), F.col("retrieved").alias("retrieved_sources"), F.col("retrieved").alias("surfaced_sources"),
    )


def answers(g: KnowledgeGraph, questions: DataFrame, systems=("graph", "lexical"), ablations: bool = False, passages: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Answers of several systems to all questions.

    ``ablations`` adds the graph without its edges and without time; what is
    named and which passages match is worked out once for all of them.
    """
    unknown = set(systems) - {"graph", "lexical"}
    if unknown:
        raise ValueError(f"unknown systems: {', '.join(sorted(unknown))}")
    questions = checkpointed(questions.select("question_id", "question", "entity", "type", "as_of"))
    read = checkpointed(passages_for(questions, passages, pages))
    found = checkpointed(resolved(g, questions)) if "graph" in systems or ablations else None
    parts = []
    if "graph" in systems:
        parts.append(from_graph(g, questions, found, read, "graph"))
    if "lexical" in systems:
        parts.append(from_text(questions, read))
    if ablations:
        parts += [from_graph(g, questions, found, read, "graph-no_graph"), from_graph(g, questions, found, read, "graph-no_temporal", temporal=False)]
    return reduce(DataFrame.unionByName, parts)


def retrieved_entities(g: KnowledgeGraph, answered: DataFrame) -> DataFrame:
    """(question_id, system, node_id): what each answer rests on and, but for the system without edges, what is next to it.

    A row for each, so a hub of any size can be among them.
    """
    own = answered.where("resolved_entity IS NOT NULL").select("question_id", "system", F.col("resolved_entity").alias("node_id"))
    ends = g.edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).union(g.edges.select("dst", "src"))
    near = own.where("system <> 'graph-no_graph'").join(ends, F.col("node_id") == F.col("_a")).select("question_id", "system", F.col("_b").alias("node_id"))
    return own.union(near).distinct()
