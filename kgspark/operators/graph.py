"""Reads of a graph: lookups, listings, counts, roll-ups, neighbours, names.

A graph is two DataFrames; every method returns a DataFrame, ordered only where
the order is part of the answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.retrieval import entity_search
from kgspark.functions.expressions import attribute, edge_key, equals, valid_on
from kgspark.plans.vocabulary import Vocabulary
from kgspark.schema import BELIEVED
from kgspark.sources.shared import checkpointed


def visible(nodes: DataFrame, edges: DataFrame, statuses=BELIEVED) -> tuple[DataFrame, DataFrame]:
    """Nodes of those statuses (none counts as current), and edges not superseded whose ends are among them, each triple once."""
    nodes = nodes.where(F.coalesce("status", F.lit("current")).isin(*statuses))
    ids = nodes.select(F.col("id").alias("_id"))
    edges = edges.where(F.coalesce("status", F.lit("current")) != "superseded")
    for end in ("src", "dst"):
        edges = edges.join(ids, edges[end] == ids["_id"], "left_semi")
    return nodes, edges.dropDuplicates(["src", "rel", "dst"])


@dataclass
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame
    vocabulary: Vocabulary = field(default_factory=Vocabulary)
    aliases: DataFrame | None = None
    lexicon: DataFrame | None = None
    findings: DataFrame | None = None
    derived: DataFrame | None = None

    # Lookups and listings.

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def edge(self, src: str, rel: str, dst: str) -> DataFrame:
        return self.edges.where((F.col("src") == src) & (F.col("rel") == rel) & (F.col("dst") == dst))

    def of_type(self, kind: str) -> DataFrame:
        """Nodes of the class, or of a union of classes, and of what they cover."""
        return self.nodes.where(F.col("type").isin(*self.vocabulary.kinds_of(kind)))

    def by_type(self, kind: str, state: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.of_type(kind).where(F.col("status") != "superseded")
        if state is not None:
            rows = rows.where(equals(attribute("state"), state))
        rows = rows.orderBy("label", "id")
        return rows.limit(limit) if limit is not None else rows

    def documents(self, like: str = "", limit: int | None = None) -> DataFrame:
        """Documents whose label or id contains the words, newest first."""
        rows = self.of_type("Document")
        if like:
            rows = rows.where(F.contains(F.lower("label"), F.lit(like.lower())) | F.contains(F.lower("id"), F.lit(like.lower())))
        rows = rows.orderBy(F.coalesce("valid_from", "as_of").desc_nulls_last(), "label", "id")
        return rows.limit(limit) if limit is not None else rows

    def superseded(self) -> DataFrame:
        return self.nodes.where(F.col("status") == "superseded")

    def predecessors(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("superseded_by") == node_id)

    def tagged(self, tag: str) -> DataFrame:
        return self.nodes.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))

    def with_attribute(self, name: str, value) -> DataFrame:
        return self.nodes.where(equals(attribute(name), value))

    def as_of(self, day: str) -> DataFrame:
        return self.nodes.where(valid_on(day))

    def policy_findings(self, limit: int | None = None) -> DataFrame:
        rows = self.findings.orderBy(F.col("severity") != "blocking", "rule", "node_id")
        return rows.limit(limit) if limit is not None else rows

    # Neighbours.

    def edges_out(self, ids: DataFrame, rel: str | None = None, id_col: str = "id") -> DataFrame:
        """(src, rel, dst) that begin at the ids; a relation stands for what specialises it."""
        return self._at("src", ids, rel, id_col)

    def edges_in(self, ids: DataFrame, rel: str | None = None, id_col: str = "id") -> DataFrame:
        return self._at("dst", ids, rel, id_col)

    def _at(self, end: str, ids: DataFrame, rel: str | None, id_col: str) -> DataFrame:
        e = self.edges.where(F.col("status") != "superseded")
        if rel is not None:
            e = e.where(F.col("rel").isin(*self.vocabulary.relations_of(rel)))
        return e.join(ids.select(F.col(id_col).alias("_id")).distinct(), F.col(end) == F.col("_id"), "left_semi").select("src", "rel", "dst")

    def neighbours(self, ids: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, other): one step in either direction, each once."""
        out = self.edges_out(ids, None, id_col).select(F.col("src").alias("id"), F.col("dst").alias("other"))
        return out.union(self.edges_in(ids, None, id_col).select("dst", "src")).distinct()

    def card(self, ids: DataFrame, each: int = 50) -> DataFrame:
        """A row for each node, with up to ``each`` edges in either direction, by relation and id.

        The limit is part of the card; edges beyond it are dropped before they are gathered.
        """
        out = self.nodes.join(ids.select("id").distinct(), "id", "left_semi")
        for name, mine, other in (("out", "src", "dst"), ("into", "dst", "src")):
            w = Window.partitionBy(mine).orderBy("rel", other)
            e = (self.edges_out if name == "out" else self.edges_in)(ids)
            e = e.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= each)
            e = e.groupBy(F.col(mine).alias("id")).agg(F.array_sort(F.collect_list(F.struct("rel", F.col(other).alias("node")))).alias(name))
            out = out.join(e, "id", "left")
        return out

    # Counts.

    def count(self, kind: str | None = None, tag: str | None = None, attr: str | None = None, value=None) -> DataFrame:
        return self._chosen(kind, tag, attr, value).agg(F.count("*").alias("n"))

    def _chosen(self, kind, tag, attr=None, value=None) -> DataFrame:
        rows = self.nodes.where(F.col("status") == "current")
        if kind:
            rows = rows.where(F.col("type").isin(*self.vocabulary.kinds_of(kind)))
        if tag:
            rows = rows.where(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(tag.lower()))))
        return rows.where(equals(attribute(attr), value)) if attr else rows

    def group_by(self, key: str, kind: str | None = None, tag: str | None = None, limit: int | None = None) -> DataFrame:
        """(value, n) by type, status or an attribute; most first, then by value, none first."""
        by = F.col(key) if key in ("type", "status") else attribute(key).text
        rows = self._chosen(kind, tag) if key != "status" else self.nodes
        rows = rows.groupBy(by.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value"))
        return rows.limit(limit) if limit is not None else rows

    def rollup(self, key: str, scheme: str, kind: str | None = None) -> DataFrame:
        """(value, n) with each value replaced by the top of its concept's broader chain."""
        tops = self.vocabulary.top_concepts(scheme)  # declared, not data: as many as the scheme has
        groups = self.group_by(key, kind)
        top = groups["value"]
        if tops:
            top = F.coalesce(F.create_map(*(F.lit(x) for pair in tops.items() for x in pair))[groups["value"]], groups["value"])
        return groups.groupBy(top.alias("value")).agg(F.sum("n").alias("n"))

    def status_counts(self) -> DataFrame:
        return self.nodes.groupBy("status").agg(F.count("*").alias("n"))

    def relation_counts(self) -> DataFrame:
        return self.edges.groupBy("rel").agg(F.count("*").alias("n"))

    def frontier(self) -> DataFrame:
        return self.nodes.agg(F.max("as_of").alias("frontier"))

    def degree(self) -> DataFrame:
        """(id, degree): edges at each node, in and out; nodes without edges have 0."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def hubs(self, limit: int) -> DataFrame:
        return self.degree().orderBy(F.desc("degree"), "id").limit(limit)

    def tag_counts(self) -> DataFrame:
        return self.nodes.where("status = 'current'").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))

    def overview(self) -> DataFrame:
        """(what, name, n): nodes by type and status, edges by relation, tags."""
        parts = [
            self.nodes.groupBy(F.lit("type").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n")),
            self.nodes.groupBy(F.lit("status"), "status").agg(F.count("*")),
            self.edges.groupBy(F.lit("relation"), "rel").agg(F.count("*")),
            self.tag_counts().select(F.lit("tag"), "tag", "n"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def summary(self) -> DataFrame:
        """One row: nodes, current and superseded ones, documents, edges, derived edges."""
        n = self.nodes.agg(
            F.count("*").alias("nodes"),
            F.count_if(F.col("status") == "current").alias("current"),
            F.count_if(F.col("status") == "superseded").alias("superseded"),
            F.count_if(F.col("type") == "Document").alias("documents"),
        )
        e = self.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("status") == "derived").alias("derived"))
        one = F.lit(1).alias("_one")
        return n.select("*", one).join(e.select("*", one), "_one").drop("_one")  # one row each

    # Names.

    def names(self) -> DataFrame:
        """(node_id, name, kind): labels, and aliases where there are any."""
        own = self.nodes.select(F.col("id").alias("node_id"), F.col("label").alias("name"), F.lit("label").alias("kind"))
        if self.aliases is not None:
            own = own.union(self.aliases.select("node_id", F.col("alias"), F.col("kind")))
        return own

    def match(self, terms: DataFrame, as_of: str | None = None) -> DataFrame:
        """(term, node_id, grade, n): the entities that the terms name, by the first grade that has any.

        Grade 1: its id; 2: its label or an alias, in any case; 3: a lexicon
        phrase.  n is the number of current ones, so n > 1 says that the term is
        ambiguous.  ``as_of`` restricts to versions valid on that day.
        """
        terms = terms.select("term").distinct()
        key = F.lower(F.trim("term"))
        held = self.nodes if as_of is None else self.nodes.where(valid_on(as_of))
        parts = [
            terms.join(held, F.col("term") == F.col("id")).select("term", F.col("id").alias("node_id"), F.lit(1).alias("grade")),
            terms.withColumn("_k", key).join(self.names().withColumn("_k", F.lower("name")), "_k").select("term", "node_id", F.lit(2)),
        ]
        if self.lexicon is not None:
            parts.append(terms.withColumn("_k", key).join(self.lexicon, F.col("_k") == F.col("phrase")).select("term", F.col("target"), F.lit(3)))
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        found = found.distinct().join(held.select(F.col("id").alias("node_id"), "status"), "node_id")
        if as_of is None:
            found = found.withColumn("current", F.col("status") == "current")
        else:
            found = found.withColumn("current", F.lit(True))
        found = found.groupBy("term", "node_id", "current").agg(F.min("grade").alias("grade"))
        best = Window.partitionBy("term")
        found = found.withColumn("_best", F.min("grade").over(best)).where("grade = _best")
        n = F.count_if("current").over(best)
        return found.select("term", "node_id", F.col("grade").cast("long").alias("grade"), n.alias("n"))

    def near_misses(self, terms: DataFrame, limit: int = 6) -> DataFrame:
        """(term, candidates): for terms that name no entity, the closest by text.  They are not matches."""
        lost = terms.select("term").distinct().join(self.match(terms).select("term").distinct(), "term", "left_anti")
        found = entity_search(self.nodes, lost, limit).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
        return found.select("term", F.transform("c", lambda x: x["id"]).alias("candidates"))

    def docs_count(self, prefix: str) -> DataFrame:
        """(n): documents whose source starts so."""
        return self.nodes.where((F.col("type") == "Document") & F.startswith("source_doc", F.lit(prefix))).agg(F.count("*").alias("n"))

    def derived_at(self, ids: DataFrame) -> DataFrame:
        """(id, src, rel, dst): derived edges at nodes, either end."""
        e = self.edges.where("status = 'derived'").select("src", "rel", "dst")
        ends = e.withColumn("id", F.explode(F.array_distinct(F.array("src", "dst"))))
        return ends.join(ids.select("id").distinct(), "id").select("id", "src", "rel", "dst")

    # Explanations.

    def explain(self, src: str, rel: str, dst: str, depth: int = 50) -> DataFrame:
        """(level, edge, derived_by, premises): a derived edge and, level by level, the edges that it rests on."""
        keyed = self.edges.select(edge_key().alias("edge"), "derived_by", "premises")
        level = checkpointed(keyed.where(F.col("edge") == f"{src} -{rel}-> {dst}").withColumn("level", F.lit(0)))
        seen = level
        for k in range(1, depth + 1):
            below = level.select(F.explode("premises").alias("edge")).distinct()
            level = checkpointed(keyed.join(below, "edge", "left_semi").join(seen, "edge", "left_anti").withColumn("level", F.lit(k)))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        return seen.select(F.col("level").cast("long").alias("level"), "edge", "derived_by", "premises")

