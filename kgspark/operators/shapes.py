"""Constraint findings: required attributes, value rules, relation counts, requirements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.expressions import Value, attribute, of_json, present, type_fits, value_problem
from kgspark.operators.graph import visible
from kgspark.plans.vocabulary import Vocabulary, _listed

VALUE_KEYS = ("pattern", "min_length", "min_value", "max_value")
SHAPE = "kind string, node_id string, class string, subject string"


def findings(vocabulary: Vocabulary, nodes: DataFrame, edges: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """(kind, node_id, class, subject) of every current node that breaks a declared shape.

    kind is required, value, min, max or requires.  Nodes are read once for all
    attribute rules, and edges are counted by node and relation once.
    """
    nodes, edges = visible(nodes, edges)
    counts = edges.groupBy("src").pivot("rel", sorted(vocabulary.properties)).count() if vocabulary.properties else None
    rows = nodes
    if counts is not None:
        counts = counts.select(F.col("src").alias("_src"), *(F.coalesce(f"`{r}`", F.lit(0)).alias(f"_n_{r}") for r in sorted(vocabulary.properties)))
        rows = rows.join(counts, rows["id"] == counts["_src"], "left")
    names = sorted({n for k in vocabulary.classes for n in vocabulary.attributes(k)})
    if derived is not None:
        d = derived.groupBy(F.col("node_id").alias("_did")).pivot("name", names).agg(F.first("value"))
        d = d.select("_did", *(F.col(f"`{n}`").alias(f"_d_{n}") for n in names))
        rows = rows.join(d, rows["id"] == d["_did"], "left")

    def value(name: str) -> Value:
        v = attribute(name)
        if derived is None or name not in names:
            return v
        o = of_json(F.col(f"_d_{name}"))
        return Value(F.coalesce(v.json, o.json), F.coalesce(v.text, o.text))

    def n_of(relation: str):
        parts = [F.coalesce(F.col(f"_n_{r}"), F.lit(0)) for r in vocabulary.relations_of(relation) if r in vocabulary.properties]
        return reduce(lambda a, b: a + b, parts)

    cases = []
    for kind in sorted(vocabulary.classes):
        mine = F.col("type") == kind
        attrs = vocabulary.attributes(kind)
        for name, spec in sorted(attrs.items()):
            if spec.get("required"):
                cases.append(("required", name, mine & ~present(value(name))))
            if any(spec.get(k) is not None for k in VALUE_KEYS):
                cases.append(("value", name, mine & present(value(name)) & value_problem(spec, value(name))))
        for relation, spec in sorted(vocabulary.properties.items()):
            domain = _listed(spec.get("domain"))
            if domain and kind not in set().union(*map(vocabulary.covers, domain)):
                continue
            if spec.get("min"):
                cases.append(("min", relation, mine & (n_of(relation) < spec["min"])))
            if spec.get("max") is not None:
                cases.append(("max", relation, mine & (n_of(relation) > spec["max"])))
        for item in vocabulary.requirements(kind):
            if item in attrs:
                cases.append(("requires", item, mine & ~present(value(item))))
            elif item in vocabulary.properties:
                cases.append(("requires", item, mine & (n_of(item) == 0)))
    if not cases:
        return nodes.sparkSession.createDataFrame([], SHAPE)
    hit = F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("subject"))) for k, s, c in cases))
    rows = rows.select("id", "type", F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.kind", F.col("id").alias("node_id"), F.col("type").alias("class"), "x.subject")


def mistyped(vocabulary: Vocabulary, nodes: DataFrame) -> DataFrame:
    """(node_id, class, name): attributes whose value has not the declared type."""
    cases = []
    for kind in sorted(vocabulary.classes):
        for name, spec in sorted(vocabulary.attributes(kind).items()):
            bad = (F.col("type") == kind) & ~type_fits(spec.get("type", "string"), attribute(name))
            cases.append(F.when(bad, F.lit(name)))
    if not cases:
        return nodes.sparkSession.createDataFrame([], "node_id string, class string, name string")
    names = F.filter(F.array(*cases), lambda x: x.isNotNull())
    return nodes.select(F.col("id").alias("node_id"), F.col("type").alias("class"), F.explode(names).alias("name"))


def undeclared(vocabulary: Vocabulary, nodes: DataFrame) -> DataFrame:
    """(class, name, n): attributes that nodes carry and their class does not declare."""
    rows = nodes.select("type", F.explode(F.map_keys(F.from_json("attributes", "map<string,string>"))).alias("name"))
    counts = rows.groupBy(F.col("type").alias("class"), "name").agg(F.count("*").alias("n"))
    known = F.lit(False)
    for kind in vocabulary.classes:
        if names := sorted(vocabulary.attributes(kind)):
            known = known | ((F.col("class") == kind) & F.col("name").isin(*names))
    return counts.where(~known)


def endpoint_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel, src_type, dst_type, n): what relations connect."""
    types = nodes.select("id", "type")
    e = edges.select("src", "rel", "dst")
    e = e.join(types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src")
    e = e.join(types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    return e.groupBy("rel", "src_type", "dst_type").agg(F.count("*").alias("n"))


def nonconforming(vocabulary: Vocabulary, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel, side, actual, n): edges whose end is not of the declared domain or range."""
    ends = endpoint_types(nodes, edges)
    parts = []
    for side, col in (("domain", "src_type"), ("range", "dst_type")):
        fits = F.lit(False)
        for rel, spec in vocabulary.properties.items():
            declared = _listed(spec.get(side))
            ok = (F.col("rel") == rel) & (F.col(col).isin(*sorted(set().union(*map(vocabulary.covers, declared)))) if declared else F.lit(True))
            fits = fits | ok
        parts.append(ends.where(~fits).groupBy("rel", F.lit(side).alias("side"), F.col(col).alias("actual")).agg(F.sum("n").alias("n")))
    return parts[0].union(parts[1])


def widen(vocabulary: Vocabulary, nodes: DataFrame, edges: DataFrame, frequent: int = 5) -> DataFrame:
    """Nonconforming ends that occur at least ``frequent`` times: candidates to widen a declaration by."""
    return nonconforming(vocabulary, nodes, edges).where(F.col("n") >= frequent)
