"""Readings for those who ask: relationships as they are visible, terms with their use, stale facts, phrases resolved, and what bears on an entity.

Each takes a table of ids or terms and answers all of them in one plan.  The
vocabulary is configuration; its names, labels and hierarchies enter plans as
small literal tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.expressions import attribute, valid_on
from kgspark.operators.fuzzy import lexicon_fuzzy
from kgspark.operators.graph import KnowledgeGraph
from kgspark.plans.vocabulary import DEFAULT_LANGUAGE, Vocabulary, label, text_in


def _status() -> Column:
    return F.coalesce(F.col("status"), F.lit("current"))


def _said(names: dict[str, str], column: str) -> Column:
    """What the names are called; null for others."""
    if not names:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]), F.col(column))


def inverse_labels(vocabulary: Vocabulary, language: str = DEFAULT_LANGUAGE) -> dict[str, str]:
    """How relations read from their targets: the label written for it, or that of the inverse."""
    out = {}
    for name, spec in vocabulary.properties.items():
        if inverse := (spec or {}).get("inverse"):
            out[name] = text_in(spec.get("inverse_label"), language) or label(vocabulary.properties.get(inverse), inverse, language)
    return out


def relationships(
    graph: KnowledgeGraph, ids: DataFrame, rel: str | None = None, history: bool = False, as_of: str | None = None, language: str = DEFAULT_LANGUAGE
) -> DataFrame:
    """(id, direction, rel, said, other, derived_by): the edges that a card of each id shows.

    Now: no superseded edge, and none to a superseded node.  With ``history``:
    all.  ``as_of`` a day: edges of any status whose other end was valid then.
    An end that is not in the graph hides nothing.  ``said`` is the relation's
    label in the language, read from its target by its inverse, if it has one.
    """
    edges = graph.edges if history or as_of is not None else graph.edges.where(_status() != "superseded")
    if rel is not None:
        edges = edges.where(F.col("rel").isin(*graph.vocabulary.relations_of(rel)))
    hidden = None
    if as_of is not None:
        hidden = ~F.coalesce(valid_on(as_of), F.lit(False))
    elif not history:
        hidden = _status() == "superseded"
    forward = {name: label(spec, name, language) for name, spec in graph.vocabulary.properties.items()}
    ids = ids.select("id").distinct()
    parts = []
    for direction, mine, other, said in (("out", "src", "dst", forward), ("in", "dst", "src", inverse_labels(graph.vocabulary, language))):
        e = edges.select(F.col(mine).alias("id"), F.lit(direction).alias("direction"), "rel", _said(said, "rel").alias("said"), F.col(other).alias("other"), "derived_by")
        e = e.join(ids, "id", "left_semi")
        if hidden is not None:
            e = e.join(graph.nodes.where(hidden).select(F.col("id").alias("other")), "other", "left_anti")
        parts.append(e.select("id", "direction", "rel", "said", "other", "derived_by"))
    return parts[0].union(parts[1])


def definitions(graph: KnowledgeGraph, language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """(kind, name, said, definition, own, covered): every class, relation and concept, and how much of the graph uses it.

    own counts current nodes of the class, edges of the relation, current nodes
    with the concept in an attribute of its scheme; covered counts what it covers
    as well: kinds of the class, relations that specialise it, narrower concepts.
    """
    v, spark = graph.vocabulary, graph.nodes.sparkSession
    terms, covers = [], []

    def add(kind, name, spec, members):
        terms.append((kind, name, label(spec, name.split(":")[-1], language), text_in((spec or {}).get("definition"), language) or None))
        covers.extend((kind, name, m) for m in {name, *members})

    for name, spec in v.classes.items():
        add("class", name, spec, v.covers(name))
    for name, spec in v.properties.items():
        add("relation", name, spec, v.relations_of(name))
    for scheme, concepts in v.schemes.items():
        for name, spec in concepts.items():
            add("concept", f"{scheme}:{name}", spec, (f"{scheme}:{c}" for c in v.narrower(scheme, name)))
    current = graph.nodes.where(_status() == "current")
    used = [
        current.select(F.lit("class").alias("kind"), F.col("type").alias("member")),
        graph.edges.select(F.lit("relation"), "rel"),
    ]
    for owner, spec in v.classes.items():
        for name, declared in (spec.get("attributes") or {}).items():
            scheme = str((declared or {}).get("type") or "")
            if scheme.startswith("scheme:"):
                value = F.concat(F.lit(scheme.removeprefix("scheme:") + ":"), attribute(name).text)
                used.append(current.where(F.col("type").isin(*v.kinds_of(owner))).select(F.lit("concept"), value))
    counts = reduce(DataFrame.union, used).groupBy("kind", "member").agg(F.count("*").alias("n"))
    counts = spark.createDataFrame(covers, "kind string, name string, member string").join(counts, ["kind", "member"], "left")
    n = F.coalesce("n", F.lit(0))
    counts = counts.groupBy("kind", "name").agg(F.sum(F.when(F.col("member") == F.col("name"), n).otherwise(0)).alias("own"), F.sum(n).alias("covered"))
    named = spark.createDataFrame(terms, "kind string, name string, said string, definition string")
    return named.join(counts, ["kind", "name"]).select("kind", "name", "said", "definition", "own", "covered")


def stale(nodes: DataFrame) -> DataFrame:
    """(id, label, valid_to, superseded_by, successor_status): superseded facts; the status is null where no successor is named or the graph lacks it."""
    after = nodes.select(F.col("id").alias("superseded_by"), _status().alias("successor_status"))
    gone = nodes.where("status = 'superseded'").select("id", "label", "valid_to", "superseded_by")
    return gone.join(after, "superseded_by", "left").select("id", "label", "valid_to", "superseded_by", "successor_status")


def resolve(graph: KnowledgeGraph, terms: DataFrame) -> DataFrame:
    """(term, how, canonical, note, target, label, status): what phrases stand for, and whether the graph has it.

    By the first of these that finds anything: "phrase", a wording of the
    lexicon; "substring", wordings that stand in the term or that it stands in;
    "name", the entity's own names.  status is the target's in the graph, null
    if it is not there; a wording without a target keeps its row.  Blank terms
    stand for nothing.
    """
    terms = terms.select("term").where(F.trim("term") != "").distinct().withColumn("_key", F.lower(F.trim("term")))
    lexicon = graph.lexicon.select("phrase", "canonical", "target", "status", "note")
    exact = terms.join(lexicon, F.col("_key") == F.col("phrase")).select("term", F.lit("phrase").alias("how"), "canonical", "note", "target").distinct()
    rest = terms.join(exact.select("term"), "term", "left_anti")
    near = lexicon_fuzzy(lexicon, rest.select(F.col("_key").alias("term")), None).withColumnRenamed("term", "_key")
    near = rest.join(near, "_key").select("term", F.lit("substring"), "canonical", "note", "target").distinct()
    rest = rest.join(near.select("term"), "term", "left_anti")
    none = F.lit(None).cast("string")
    named = graph.match(rest).select("term", F.lit("name"), none, none, "node_id")
    held = graph.nodes.select(F.col("id").alias("target"), "label", _status().alias("status"))
    return exact.union(near).union(named).join(held, "target", "left").select("term", "how", "canonical", "note", "target", "label", "status")


def bearing(graph: KnowledgeGraph, ids: DataFrame, decisions: str, files: dict[str, str | None]) -> DataFrame:
    """(id, section, other, rel, direction, detail): what bears on each entity.

    Sections: "decision", current neighbours of the classes ``decisions``;
    "file", those of the classes ``files``, with the attribute that says where,
    or else their label; "phrase", wordings of the lexicon that lead to the
    entity; "source", documents that it was read from, with their names.
    """
    v = graph.vocabulary
    ids = ids.select("id").distinct()
    current = graph.nodes.where(_status() == "current")
    near = relationships(KnowledgeGraph(current, graph.edges.where(_status() == "current"), v), ids).where("other <> id")
    chosen = F.col("type").isin(*v.kinds_of(decisions))
    where, section = F.lit(None).cast("string"), F.when(chosen, "decision")
    for kind, name in files.items():
        of = F.col("type").isin(*v.kinds_of(kind))
        section = section.when(of, "file")
        if name is not None:
            where = F.when(of, attribute(name).text).otherwise(where)
    others = current.select(F.col("id").alias("other"), section.alias("section"), F.coalesce(F.when(~chosen, where), "label").alias("detail")).where("section IS NOT NULL")
    out = near.join(others, "other").select("id", "section", "other", "rel", "direction", "detail")
    none = F.lit(None).cast("string")
    if graph.lexicon is not None:
        wordings = graph.lexicon.select(F.col("target").alias("id"), "phrase", "canonical").join(ids, "id", "left_semi")
        out = out.union(wordings.select("id", F.lit("phrase"), "canonical", none, none, "phrase").distinct())
    said = F.array(F.col("source_doc"))
    if "evidence" in graph.nodes.columns:
        said = F.concat(F.coalesce(F.transform("evidence", lambda e: e["doc"]), F.array().cast("array<string>")), said)
    sources = graph.nodes.join(ids, "id", "left_semi").select("id", F.explode(F.array_distinct(said)).alias("doc")).where("doc <> ''")
    documents = graph.of_type("Document").select(F.col("id").alias("other"), F.explode(F.array_distinct(F.array(F.regexp_replace("id", r"^document\.", ""), "label"))).alias("doc"))
    documents = documents.groupBy("doc").agg(F.min("other").alias("other"))
    return out.union(sources.join(documents, "doc", "left").select("id", F.lit("source"), "other", none, none, "doc"))
