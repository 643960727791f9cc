"""Forward-chained rules to a fixpoint, and policies over the result.

Every round evaluates the rules in order; a rule sees what earlier rules of the
round derived.  A rule that ran before is evaluated on what is new since: once for
each premise that new edges can satisfy, with those edges in its place, beginning
there, and all facts in the others'.  If nothing that it reads is new, it does not
run.  New facts are what an anti join with the known ones leaves; they are
checkpointed to the shared folder, so a round's plan does not grow with the number
of rounds and survives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.expressions import edge_key
from kgspark.operators.graph import visible
from kgspark.plans.pattern import USED, Matcher
from kgspark.plans.vocabulary import Vocabulary, _listed
from kgspark.schema import BELIEVED_OR_INTENDED
from kgspark.sources.shared import checkpointed

MAX_ROUNDS = 50

_EDGE = "src string, rel string, dst string, status string, derived_by string, premises array<string>, depth long"
_ATTRIBUTE = "node_id string, name string, value string, derived_by string, premises array<string>, depth long"


class DoesNotConverge(RuntimeError):
    pass


@dataclass
class Derived:
    edges: DataFrame
    attributes: DataFrame
    rounds: int


def problems(rule: dict) -> list[str]:
    """Why a rule cannot run; a rule that derives may not negate or have optional parts."""
    out = []
    bound = {p["node"] for p in rule["when"] if "node" in p} | {v for p in rule["when"] if "edge" in p for v in (p["edge"][0], p["edge"][2]) if v != "*"}
    if rule["kind"] == "derive":
        out += [f"{rule['id']}: a derive rule has no {k}" for k in ("not", "not_edge", "not_node", "optional") if any(k in p for p in rule["when"])]
        then = rule["then"]
        used = [then["edge"][0], then["edge"][2]] if "edge" in then else [then["attribute"][0]]
        out += [f"{rule['id']}: {v} is not bound" for v in used if v not in bound]
    return out


def derive(nodes: DataFrame, edges: DataFrame, rules: list[dict], vocabulary: Vocabulary | None = None, max_rounds: int = MAX_ROUNDS) -> Derived:
    """All edges and attributes that the ``derive`` rules add.

    Asserted facts win, then the first derivation in rule order; among the
    bindings of one rule the one with the smallest premises.
    """
    wrong = [p for r in rules for p in problems(r)]
    if wrong:
        raise ValueError("; ".join(wrong))
    spark = nodes.sparkSession
    new_edges, new_attrs = spark.createDataFrame([], _EDGE), spark.createDataFrame([], _ATTRIBUTE)
    chained, read = _chained(rules), _relations(rules)
    nodes, base = visible(nodes, edges if read is None else edges.where(F.col("rel").isin(*read)))
    base = checkpointed(base.select("src", "rel", "dst", "status", "derived_by", "premises"))
    news: list[tuple[str, str, DataFrame]] = []  # ("edge" or "attribute", its name, the facts), in the order in which they came
    ran: dict[str, int] = {}  # how many of them there were when a rule ran last
    for number in range(1, max_rounds + 2):
        if number > max_rounds:
            raise DoesNotConverge(f"no fixpoint in {max_rounds} rounds")
        grown = False
        for rule in (r for r in rules if r["kind"] == "derive"):
            reads = rule["id"] in chained
            m = Matcher(nodes, base.unionByName(new_edges.drop("depth")), vocabulary, derived=new_attrs.select("node_id", "name", "value") if reads else None, track=True, seen=True)
            matched = _matched(rule, m, news, ran.get(rule["id"]))
            ran[rule["id"]] = len(news)
            if matched is None:
                continue
            found = _with_premises(matched, new_edges if reads else None)
            fresh = _edges(rule, found, base, new_edges) if "edge" in rule["then"] else _attributes(rule, found, m, nodes, new_attrs)
            fresh = checkpointed(fresh)
            if fresh.isEmpty():
                continue
            grown = True
            if "edge" in rule["then"]:
                new_edges = new_edges.unionByName(fresh)
                news.append(("edge", rule["then"]["edge"][1], fresh))
            else:
                new_attrs = new_attrs.unionByName(fresh)
                news.append(("attribute", rule["then"]["attribute"][1], fresh))
        if not grown or not chained:
            return Derived(new_edges, new_attrs, number)
    raise AssertionError


def _matched(rule: dict, m: Matcher, news: list[tuple[str, str, DataFrame]], since: int | None) -> DataFrame | None:
    """The bindings of a rule that rest on what is new since it ran (all, if it never did), or none if nothing is that it reads."""
    when = rule["when"]
    if since is None:
        return m.match(when)
    value = rule["then"]["attribute"][2] if "attribute" in rule["then"] else None
    names = {n for p in when for n in p.get("where") or {}} | ({value.partition(".")[2]} if isinstance(value, str) else set())
    fresh = news[since:]
    if any(kind == "attribute" and name in names for kind, name, _ in fresh):
        return m.match(when)
    parts = []
    for i, p in enumerate(when):
        wanted = _listed(p["edge"][1]) if "edge" in p else []
        new = [df for kind, rel, df in fresh if kind == "edge" and "edge" in p and (not wanted or rel in wanted)]
        if not new:
            continue
        if any(isinstance(x, str) and "$" in x for q in when for _, _, x in m._conditions(q.get("where"))):
            return m.match(when)  # what a reference means depends on the order of patterns
        parts.append(_from(i, when, reduce(DataFrame.unionByName, new), m))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def _from(i: int, when: list[dict], new: DataFrame, m: Matcher) -> DataFrame:
    """Bindings of the patterns with the i-th, an edge, taken from ``new``.

    They are matched from that edge on, each next one connected where it can
    be; the used edges are put in the order of the patterns after that.
    """
    edges = [k for k, p in enumerate(when) if "edge" in p]
    order, bound, rest = [i], {v for v in (when[i]["edge"][0], when[i]["edge"][2]) if v != "*"}, [k for k in edges if k != i]
    while rest:
        k = next((k for k in rest if bound & {when[k]["edge"][0], when[k]["edge"][2]}), rest[0])
        rest.remove(k)
        order.append(k)
        bound |= {v for v in (when[k]["edge"][0], when[k]["edge"][2]) if v != "*"}
    patterns = [when[k] | ({"of": new} if k == i else {}) for k in order]
    found = m.match([*patterns, *(p for p in when if "edge" not in p)])
    return found.withColumn(USED, F.array(*(F.get(USED, F.lit(order.index(k))) for k in edges)))


def _chained(rules: list[dict]) -> set[str]:
    """Rules that read a relation or an attribute that some rule derives."""
    derives = [r for r in rules if r["kind"] == "derive"]
    rels = {r["then"]["edge"][1] for r in derives if "edge" in r["then"]}
    names = {r["then"]["attribute"][1] for r in derives if "attribute" in r["then"]}

    def reads(p: dict) -> bool:
        if "edge" in p:
            wanted = [x.strip() for x in (p["edge"][1] or "").split("|") if x.strip()]
            return not wanted and bool(rels) or bool(rels & set(wanted))
        return bool(names & set(p.get("where") or {}))

    out = {r["id"] for r in derives if any(map(reads, r["when"]))}
    copies = {r["id"] for r in derives if "attribute" in r["then"] and isinstance(r["then"]["attribute"][2], str) and r["then"]["attribute"][2].partition(".")[2] in names}
    return out | copies


def _relations(rules: list[dict]) -> list[str] | None:
    """What the derive rules read or derive; none if one of them reads any relation."""
    out = set()
    for r in (r for r in rules if r["kind"] == "derive"):
        specs = [p["edge"] for p in r["when"] if "edge" in p] + ([r["then"]["edge"]] if "edge" in r["then"] else [])
        for spec in specs:
            if not _listed(spec[1]):
                return None
            out |= set(_listed(spec[1]))
    return sorted(out)


def _with_premises(found: DataFrame, new_edges: DataFrame | None) -> DataFrame:
    """Adds _premises, the bound ids in order and the used edges, and _depth (1 where no derived edge can be among them)."""
    variables = [c for c in found.columns if not c.startswith("_")]
    found = found.withColumn("_premises", F.concat(F.array_sort(F.array_distinct(F.array(*variables))), F.col(USED)))
    if new_edges is None:
        return found.withColumn("_depth", F.lit(1))
    depths = new_edges.select(edge_key().alias("_key"), "depth")
    rows = found.select(F.xxhash64("_premises").alias("_h"), F.explode_outer(USED).alias("_key")).join(depths, "_key").groupBy("_h").agg(F.max("depth").alias("_d"))
    found = found.withColumn("_h", F.xxhash64("_premises")).join(rows, "_h", "left")
    return found.withColumn("_depth", F.coalesce("_d", F.lit(0)) + 1)


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("premises")
    return rows.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def _edges(rule: dict, found: DataFrame, base: DataFrame, known: DataFrame) -> DataFrame:
    src, rel, dst = rule["then"]["edge"]
    rows = found.select(
        F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"), F.lit("derived").alias("status"),
        F.lit(rule["id"]).alias("derived_by"), F.col("_premises").alias("premises"), F.col("_depth").cast("long").alias("depth"),
    )
    keys = ["src", "rel", "dst"]
    rows = rows.join(base.where(F.col("rel") == rel).select(*keys), keys, "left_anti").join(known.where(F.col("rel") == rel).select(*keys), keys, "left_anti")
    return _first(rows, keys)


def _attributes(rule: dict, found: DataFrame, m: Matcher, nodes: DataFrame, known: DataFrame) -> DataFrame:
    var, name, value = rule["then"]["attribute"]
    if isinstance(value, str) and value.startswith("$"):
        other, _, attr = value[1:].partition(".")
        if attr:
            found = m._read(found, other, attr, "_v")
            column = F.col("_v_json")
        else:
            column = F.to_json(F.array(other)).substr(F.lit(2), F.length(other) + 2)
    else:
        import json

        column = F.lit(json.dumps(value))
    rows = found.select(
        F.col(var).alias("node_id"), F.lit(name).alias("name"), column.alias("value"),
        F.lit(rule["id"]).alias("derived_by"), F.col("_premises").alias("premises"), F.col("_depth").cast("long").alias("depth"),
    ).where("value IS NOT NULL")
    asserted = nodes.where(F.get_json_object("attributes", f"$.{name}").isNotNull()).select(F.col("id").alias("node_id"))
    rows = rows.join(asserted, "node_id", "left_anti").join(known.where(F.col("name") == name).select("node_id"), "node_id", "left_anti")
    return _first(rows, ["node_id", "name"])


def policies(nodes: DataFrame, edges: DataFrame, rules: list[dict], vocabulary: Vocabulary | None = None, derived: Derived | None = None) -> DataFrame:
    """(rule, severity, node_id, message) of the policy rules, over current, intended and derived facts."""
    all_edges = edges.select("src", "rel", "dst", "status", "derived_by", "premises")
    attrs = None
    if derived is not None:
        all_edges = all_edges.unionByName(derived.edges.drop("depth"))
        attrs = derived.attributes.select("node_id", "name", "value")
    m = Matcher(nodes, all_edges, vocabulary, BELIEVED_OR_INTENDED, attrs)
    parts = []
    for r in (r for r in rules if r["kind"] == "policy"):
        found = m.match(r["when"])
        first = _first_variable(r["when"])
        subject = F.col(first) if first else F.lit(None).cast("string")
        variables = [c for c in found.columns if not c.startswith("_")]
        found = found.select(*variables).distinct() if variables else found
        parts.append(found.select(F.lit(r["id"]).alias("rule"), F.lit(r.get("severity", "warn")).alias("severity"), subject.alias("node_id"), F.lit(r["then"]["flag"]).alias("message")))
    if not parts:
        from kgspark.schema import FINDINGS

        return nodes.sparkSession.createDataFrame([], FINDINGS)
    return reduce(DataFrame.union, parts)


def _first_variable(when: list[dict]) -> str | None:
    for p in when:
        if "node" in p:
            return p["node"]
        if "edge" in p:
            return next((v for v in (p["edge"][0], p["edge"][2]) if v != "*"), None)
    return None
