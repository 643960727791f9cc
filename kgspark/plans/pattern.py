"""Graph patterns as joins.

A pattern list binds variables to node ids.  Bindings are a DataFrame with one
column for each variable, and every pattern is one relational step on it:

    {"node": "p", "type": "Order", "where": {...}}   inner join with nodes (a filter, if p is bound)
    {"edge": ["p", "placed_by|owned_by", "c"]}       inner equi-join with edges (or those of "of"); "*" binds nothing
    {"not_edge": [...]}, {"not": [patterns]}         left anti join
    {"not_node": ..., "type": ..., "where": ...}     left anti join with nodes
    {"optional": [patterns]}                         left outer join

Nothing is evaluated here; Catalyst orders and executes the joins.  A node
pattern whose variable a later edge pattern binds waits for that edge, so
connected patterns never become a cross product.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.expressions import Value, compare, edge_key, of_json, of_text, reading
from kgspark.operators.graph import visible
from kgspark.plans.vocabulary import Vocabulary, _listed
from kgspark.schema import BELIEVED
from kgspark.sources.shared import checkpointed

_REFERENCE = re.compile(r"\$([A-Za-z_]\w*)(?:\.([A-Za-z_]\w*))?")
USED = "_used"


class Matcher:
    """Matches patterns against what is visible of a graph.

    ``derived`` has derived attributes (node_id, name, value as JSON), read where
    none is asserted.  ``track`` keeps the keys of the edges that a binding used
    in the column ``_used``.  ``seen`` says that only what is visible was given.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, vocabulary: Vocabulary | None = None, statuses=BELIEVED, derived: DataFrame | None = None, track: bool = False, seen: bool = False):
        self.vocabulary = vocabulary or Vocabulary()
        self.nodes, self.edges = (nodes, edges) if seen else visible(nodes, edges, statuses)
        self.derived, self.track = derived, track
        self.spark = nodes.sparkSession
        self.loose: set[str] = set()  # variables that an optional block may have left unbound
        self.splits = 0  # steps that took bindings more than once

    # Values.

    def _value(self, rows: DataFrame, name: str) -> tuple[DataFrame, Value]:
        """A node table with what the attribute's reading needs, and the value.

        A name that any class declares is the declared attribute in that class only.
        """
        derived = None
        if self.derived is not None:
            d = self.derived.where(F.col("name") == name).groupBy(F.col("node_id").alias("_nid")).agg(F.first("value").alias(f"_d_{name}"))
            rows = rows.join(d, rows["id"] == d["_nid"], "left").drop("_nid")
            derived = of_json(F.col(f"_d_{name}"))
        v = reading(name, rows.columns, derived=derived)
        js, text = v.json, v.text
        for kind in self.vocabulary.classes:
            spec = self.vocabulary.attributes(kind).get(name)
            if spec is not None:
                own = reading(name, rows.columns, spec.get("was") if isinstance(spec.get("was"), dict) else None, spec.get("default"), True, derived)
                js, text = F.when(F.col("type") == kind, own.json).otherwise(js), F.when(F.col("type") == kind, own.text).otherwise(text)
        return rows, Value(js, text)

    def read(self, bindings: DataFrame, var: str, name: str, out: str) -> DataFrame:
        """Adds the attribute's text of the node bound to ``var`` (null where there is none)."""
        return self._read(bindings, var, name, out, False)

    def _read(self, bindings: DataFrame, var: str, name: str, out: str, with_json: bool = True) -> DataFrame:
        rows, v = self._value(self.nodes, name)
        rows = rows.select(F.col("id").alias("_rid"), v.text.alias(out), *([v.json.alias(f"{out}_json")] if with_json else []))
        return bindings.join(rows, F.col(var) == F.col("_rid"), "left").drop("_rid")

    # Conditions.

    @staticmethod
    def _conditions(where: dict | None):
        for name, condition in (where or {}).items():
            for op, expected in (condition if isinstance(condition, dict) else {"=": condition}).items():
                yield name, op, expected

    def _refers(self, expected, bound: set[str]) -> bool:
        return isinstance(expected, str) and any(m[1] in bound for m in _REFERENCE.finditer(expected))

    def _candidates(self, pattern: dict, bound: set[str]) -> tuple[DataFrame, list[tuple[str, str, object, Value]]]:
        """Nodes that fit type and constant conditions, and the conditions that refer to variables."""
        rows = self.nodes
        if kinds := _listed(pattern.get("type")):
            rows = rows.where(F.col("type").isin(*sorted(set().union(*map(self.vocabulary.covers, kinds)))))
        later = []
        for i, (name, op, expected) in enumerate(self._conditions(pattern.get("where"))):
            rows, v = self._value(rows, name) if name != "id" else (rows, of_text(F.col("id")))
            if self._refers(expected, bound):
                rows = rows.withColumns({f"_w{i}": v.text, f"_w{i}_json": v.json})
                later.append((f"_w{i}", op, expected, Value(F.col(f"_w{i}_json"), F.col(f"_w{i}"))))
            else:
                rows = rows.where(compare(op, v, expected))
        keep = [c for w, *_ in later for c in (w, f"{w}_json")]
        return rows.select(F.col("id").alias("_id"), *keep), later

    def _expected(self, bindings: DataFrame, expected: str, bound: set[str], tag: str) -> tuple[DataFrame, Value]:
        """What an expected text with references comes to, as columns of the bindings."""
        whole = _REFERENCE.fullmatch(expected)
        parts, at = [], 0
        for k, m in enumerate(_REFERENCE.finditer(expected)):
            if m[1] not in bound:
                continue
            if m[2]:
                bindings = self._read(bindings, m[1], m[2], f"{tag}_{k}")
                value = Value(F.col(f"{tag}_{k}_json"), F.col(f"{tag}_{k}"))
            else:
                value = of_text(F.col(m[1]))
            if whole:
                return bindings, value
            parts += [F.lit(expected[at : m.start()]), F.coalesce(value.text, F.lit(""))]
            at = m.end()
        return bindings, of_text(F.concat(*parts, F.lit(expected[at:])))

    def _joined(self, bindings: DataFrame, pattern: dict, bound: set[str], on: Column | None, how: str) -> DataFrame:
        rows, later = self._candidates(pattern, bound)
        conds = [] if on is None else [on]
        for name, op, expected, value in later:
            bindings, other = self._expected(bindings, expected, bound, f"_e{name}")
            if op == "=":  # an equi-join, besides the typed comparison
                conds.append(value.text == other.text)
            conds.append(compare(op, value, other))
        if not conds and how == "left_anti":  # absence of any such node: one row decides
            rows, conds = rows.limit(1), [F.lit(True)]
        if not conds:
            return bindings.crossJoin(rows)  # two parts that the question itself leaves unconnected
        return bindings.join(rows, reduce(lambda a, b: a & b, conds), how)

    # Steps.

    def start(self, params: dict[str, str] | None = None) -> DataFrame | None:
        """One row with the parameters, or nothing bound."""
        if not params:
            return None
        return self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in params.items()), *([F.array().cast("array<string>").alias(USED)] if self.track else []))

    def match(self, when: list[dict], bindings: DataFrame | None = None) -> DataFrame:
        """Bindings that satisfy all patterns.  With no variables bound at all, one empty row stands for yes."""
        todo = list(when)
        if bindings is None:
            self.loose = set()
        while todo:
            at = next((i for i, p in enumerate(todo) if not self._waits(p, todo[i + 1 :], self._variables(bindings))), 0)
            at = self._surer(todo, at, self._variables(bindings))
            bindings = self._step(todo.pop(at), bindings)
        return bindings if bindings is not None else self.spark.range(1).select(F.lit(True).alias("_yes"))

    @staticmethod
    def _variables(bindings: DataFrame | None) -> set[str]:
        return set() if bindings is None else {c for c in bindings.columns if not c.startswith("_")}

    def _waits(self, pattern: dict, rest: list[dict], bound: set[str]) -> bool:
        if "node" not in pattern or pattern["node"] in bound or not bound:
            return False
        for p in rest:
            if not ("node" in p or "edge" in p):
                return False  # what follows an optional or negated block keeps its place
            if "edge" in p and pattern["node"] in (p["edge"][0], p["edge"][2]):
                return True
        return False

    def _surer(self, todo: list[dict], at: int, bound: set[str]) -> int:
        """In place of an edge that hangs on loose variables alone, which are free in some rows: the next edge with an end bound for sure."""
        sure = lambda p: any(v in bound - self.loose for v in (p["edge"][0], p["edge"][2]))
        if "edge" not in todo[at] or sure(todo[at]) or not {todo[at]["edge"][0], todo[at]["edge"][2]} & self.loose & bound:
            return at
        for i, p in enumerate(todo[at + 1 :], at + 1):
            if not ("node" in p or "edge" in p):
                break  # what follows an optional or negated block keeps its place
            if "edge" in p and sure(p):
                return i
        return at

    def _freed(self, bindings: DataFrame, variables: list[str], step) -> DataFrame:
        """``step(bindings, bound)`` for the rows where the loose ones among ``variables`` are bound, and for those where they are free.

        Loose variables are those that an optional block may have left unbound.
        """
        if set(variables) & self.loose:
            bindings = self._shared(bindings)
        parts = [(bindings, self._variables(bindings))]
        for v in sorted(set(variables) & self.loose):
            parts = [x for b, bound in parts for x in ((b.where(F.col(v).isNotNull()), bound), (b.where(F.col(v).isNull()).drop(v), bound - {v}))]
        found = [step(b, bound) for b, bound in parts]
        return reduce(lambda a, b: a.unionByName(b), found)

    def _shared(self, bindings: DataFrame) -> DataFrame:
        """For a step that takes bindings more than once.  Of several such steps each would multiply the plan, so from the second on they are written first."""
        self.splits += 1
        return checkpointed(bindings) if self.splits > 1 else bindings

    def _apart(self, block: list[dict], bound: set[str]) -> tuple[list[dict], list[str]] | None:
        """A block of one edge and conditions on its ends, edge first, and its bound variables, if it can be matched
        apart from the bindings and joined on those."""
        edges, nodes = [p for p in block if "edge" in p], [p for p in block if "node" in p]
        if len(edges) != 1 or len(edges) + len(nodes) != len(block):
            return None
        ends = [v for v in (edges[0]["edge"][0], edges[0]["edge"][2]) if v != "*"]
        shared = [v for v in ends if v in bound]  # loose ones among them have to be told apart
        said = {m[1] for p in nodes for _, _, x in self._conditions(p.get("where")) if isinstance(x, str) for m in _REFERENCE.finditer(x)}
        if not shared or len(set(ends)) < len(ends) or not {p["node"] for p in nodes} <= set(ends) or said & (bound | set(ends)) - set(shared):
            return None
        return edges + nodes, shared

    def _separately(self, block: list[dict], track: bool) -> DataFrame:
        was, loose = self.track, self.loose
        self.track = track
        try:
            return self.match(block)
        finally:
            self.track, self.loose = was, loose

    def _step(self, p: dict, bindings: DataFrame | None) -> DataFrame:
        bound = self._variables(bindings)
        if "node" in p or "edge" in p:
            ends = [p["node"]] if "node" in p else [p["edge"][0], p["edge"][2]]
            step = (lambda b, v: self._node(p, b, v)) if "node" in p else (lambda b, v: self._edge(p["edge"], b, v, "inner", p.get("of")))
            free = self.loose & bound & set(ends)
            if bindings is None or not free:
                return step(bindings, bound)
            if "edge" in p and self._held(ends, bound):
                out = self._edge(p["edge"], bindings, bound, "inner", p.get("of"))
                self.loose -= set(ends)
                return out
            out = self._freed(bindings, ends, step)
            self.loose -= set(ends)
            return out
        if bindings is None:
            bindings = self.spark.range(1).select(F.lit(True).alias("_yes"), *([F.array().cast("array<string>").alias(USED)] if self.track else []))
        if "not_edge" in p:
            ends = [p["not_edge"][0], p["not_edge"][2]]
            if not self.loose & bound & set(ends) or self._held(ends, bound):
                return self._edge(p["not_edge"], bindings, bound, "left_anti")
            free = lambda b, v: self._edge(p["not_edge"], b, v, "left_anti").withColumns({c: F.lit(None).cast("string") for c in bound - v})
            return self._freed(bindings, ends, free).select(*bindings.columns)
        if "not_node" in p:
            return self._tidy(self._joined(bindings, p, bound, None, "left_anti"), bindings)
        keys = sorted(bound)
        apart = self._apart(p.get("not", p.get("optional", [])), bound)
        free = set(apart[1]) & self.loose if apart is not None else set()
        if apart is not None and not free:
            return self._beside(p, *apart, bindings, bound)
        bindings = self._shared(bindings)
        if free and "optional" in p:
            # Where its loose variables are bound the block is matched apart; the rows that leave one free, few as a rule, are extended.
            whole, was = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in sorted(free))), set(self.loose)
            held = self._beside(p, *apart, bindings.where(whole), bound)
            self.loose = was
            return held.unionByName(self._extended(p, bindings.where(~whole), keys, bound), allowMissingColumns=True)
        if "not" in p:
            found = self._inside(p["not"], bindings, keys)
            return self._same(bindings, found, keys, "left_anti")
        if "optional" in p:
            return self._extended(p, bindings, keys, bound)
        raise ValueError(f"unknown pattern {p}")

    def _beside(self, p: dict, block: list[dict], shared: list[str], bindings: DataFrame, bound: set[str]) -> DataFrame:
        """The bindings joined with a block that is matched apart from them."""
        found = self._separately(block, self.track and "optional" in p)
        on = reduce(lambda a, b: a & b, (F.col(v) == F.col(f"_k_{v}") for v in shared))
        if "not" in p:
            return bindings.join(found.select(*(F.col(v).alias(f"_k_{v}") for v in shared)), on, "left_anti")
        new = sorted(self._variables(found) - bound)
        found = found.select(*(F.col(v).alias(f"_k_{v}") for v in shared), *new, *([F.col(USED).alias("_more")] if self.track else []))
        kept = [F.concat(F.col(USED), F.coalesce("_more", F.array().cast("array<string>"))).alias(USED) if c == USED else F.col(c) for c in bindings.columns]
        self.loose |= set(new)
        return bindings.join(found, on, "left").select(*kept, *new)

    def _extended(self, p: dict, bindings: DataFrame, keys: list[str], bound: set[str]) -> DataFrame:
        """The bindings that an optional block extends, extended, and the others."""
        was = {k: f"_was_{len(bindings.columns)}_{k}" for k in keys if k in self.loose}
        found = self._tracked(p["optional"], bindings.withColumns({c: F.col(k) for k, c in was.items()}))
        loose = set(was) | self.loose | self._variables(found) - bound
        before = found.select(*(F.col(was.get(k, k)).alias(k) for k in keys))
        alone = self._same(bindings, before, keys, "left_anti")
        self.loose = loose
        return found.drop(*was.values()).unionByName(alone, allowMissingColumns=True)

    def _tracked(self, patterns: list[dict], bindings: DataFrame) -> DataFrame:
        return self.match(patterns, bindings)

    def _inside(self, patterns: list[dict], bindings: DataFrame, keys: list[str]) -> DataFrame:
        """The distinct outer bindings that the inner patterns extend."""
        outer = bindings.select(*keys).distinct() if keys else None
        was, self.track, loose = self.track, False, set(self.loose)
        # What is free out here may be bound in there: the outer bindings keep their own columns.
        inner = {k: f"_was_{k}" for k in keys if k in loose}
        if inner:
            outer = outer.withColumns({c: F.col(k) for k, c in inner.items()})
        try:
            found = self.match(patterns, outer)
        finally:
            self.track, self.loose = was, loose
        if not keys:
            return found.limit(1)
        return found.select(*(F.col(inner.get(k, k)).alias(k) for k in keys)).distinct()

    @staticmethod
    def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
        if not keys:
            return left.join(right.select(F.lit(True).alias("_any")).limit(1), F.lit(True), how)
        right = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
        return left.join(right, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)), how)

    @staticmethod
    def _tidy(df: DataFrame, before: DataFrame) -> DataFrame:
        return df.select(*before.columns)

    def _node(self, p: dict, bindings: DataFrame | None, bound: set[str]) -> DataFrame:
        var = p["node"]
        if bindings is None:
            rows, _ = self._candidates(p, bound)
            return rows.select(F.col("_id").alias(var), *([F.array().cast("array<string>").alias(USED)] if self.track else []))
        if var in bound:
            return self._tidy(self._joined(bindings, p, bound, F.col(var) == F.col("_id"), "inner"), bindings)
        out = self._joined(bindings, p, bound, None, "inner")
        return out.select(*bindings.columns, F.col("_id").alias(var))

    def _held(self, ends: list[str], bound: set[str]) -> bool:
        """Whether one end is bound for sure, so that a loose one needs no join of its own."""
        return any(v in bound and v not in self.loose for v in ends) and len(set(ends)) == 2

    def _edge(self, spec: list[str], bindings: DataFrame | None, bound: set[str], how: str, of: DataFrame | None = None) -> DataFrame:
        src, rel, dst = spec
        e = self.edges if of is None else of
        if rels := _listed(rel):
            e = e.where(F.col("rel").isin(*rels))
        e = e.select(F.col("src").alias("_src"), F.col("rel").alias("_rel"), F.col("dst").alias("_dst"))
        new = {}
        for var, col in ((src, "_src"), (dst, "_dst")):
            if var != "*" and var not in bound:
                new[var] = col  # of one variable at both ends the second place counts
        key = F.array(edge_key("_src", "_rel", "_dst"))
        if bindings is None:
            return e.select(*(F.col(c).alias(v) for v, c in new.items()), *([key.alias(USED)] if self.track else []))
        at = [(var, col) for var, col in ((src, "_src"), (dst, "_dst")) if var != "*" and var in bound]
        mixed = [var for var, _ in at if var in self.loose] if self._held([src, dst], bound) else []  # bound in some rows only
        conds = [F.col(var).isNull() | (F.col(var) == F.col(col)) if var in mixed else F.col(var).eqNullSafe(F.col(col)) for var, col in at]
        if how == "left_anti":
            return bindings.join(e if conds else e.limit(1), reduce(lambda a, b: a & b, conds) if conds else F.lit(True), how)
        if not conds:
            out = bindings.crossJoin(e)  # unconnected, as for nodes
        else:
            out = bindings.join(e, reduce(lambda a, b: a & b, conds), how)
        kept = [F.concat(F.col(USED), key).alias(USED) if c == USED else F.coalesce(F.col(c), F.col(dict(at)[c])).alias(c) if c in mixed else F.col(c) for c in bindings.columns]
        return out.select(*kept, *(F.col(c).alias(v) for v, c in new.items()))

    # Answers.

    def select(self, bindings: DataFrame, select: list[str]) -> DataFrame:
        """The selected ids (``$x``) and attributes (``$x.name``), each row once, rows of nulls left out.

        Columns are named after the items, without the sign and with _ for the dot.
        """
        names = []
        for item in select:
            var, _, name = item.lstrip("$").partition(".")
            out = f"{var}_{name}" if name else var
            if var not in bindings.columns:
                bindings = bindings.withColumn(var, F.lit(None).cast("string"))
            if name:
                bindings = self.read(bindings, var, name, out)
            names.append(out)
        return bindings.select(*names).dropna("all").distinct()
