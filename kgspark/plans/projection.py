"""Projections of a graph into nested documents.

A projection is a nested JSON-like value; each collection becomes one DataFrame
with a column ``value`` (a row for each item), never one big object:

    {"$nodes": "Order", "$where": {...}, "$sort": "-label", "$limit": 5, "$select": {...}}
    {"$nodes": ["*"], "$group": "type", "$map": "$id"}

Other collections: $edges, and of the tables that are given $lexicon (a row for
each term), $documents, $findings, $ledger, $pending; {"$payload": "name"} is any
of them by name, {"$graph": true} all.  {"$include": "part.json"} stands for what
a file of the folder says, {"$optional": x} for x, or for nothing where its table
is not there.

Inside $select and $map: "$label", "$attr.total", "$attrs", "$row", {"$out": "placed_by", "$map": "$label"},
{"$in": ...}, {"$count": x}, {"$first": x}, {"$concat": [...]}, {"$format": "{label} ({id})"}, {"$const": x};
inside $out and $in also "$rel", "$derived_by" and "$edge_status".  A field that rows have not is null.
Superseded rows are left out unless $history is true.  With a vocabulary a class is also its subclasses.
"""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.expressions import Value, attribute, compare, of_text

TABLES = ("lexicon", "documents", "findings", "ledger", "edges", "pending")
ROOTS = ("$nodes", *(f"${t}" for t in TABLES), "$payload")
EDGE_FIELDS = ("rel", "derived_by", "edge_status")


class Projection:
    def __init__(self, nodes: DataFrame, edges: DataFrame, tables: dict[str, DataFrame] | None = None, vocabulary=None, folder: str | None = None):
        self.nodes, self.edges = nodes, edges
        self.tables, self.vocabulary, self.folder = dict(tables or {}), vocabulary, folder

    def run(self, expr: dict) -> DataFrame:
        """(value), or (key, items) for $group; in order where $sort says so."""
        expr = self._resolved(expr)
        rows, value = self._items(expr)
        if "$group" in expr:
            key = self._path(rows, expr["$group"]).text
            items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_key"), value.alias("_v")))), lambda x: x["_v"])
            return rows.groupBy(key.alias("key")).agg(items.alias("items"))
        return rows.select(value.alias("value"))

    def assembled(self, expr) -> DataFrame:
        """(path, key, no, value): a whole document of several collections, constants and counts in one plan.

        path is the place in the document, as ``a.b``; key the group where $group
        is asked for; value the item as JSON.  no rises in the order of the
        collection: from 1 without gaps where it has a $limit, with gaps elsewhere
        (no task ever holds a whole collection), and is null for single values.
        """
        parts = [self._part(path, x) for path, x in self._leaves(self._resolved(expr), "")]
        return reduce(DataFrame.unionByName, parts)

    # Collections.

    def _resolved(self, x):
        """Includes read, and what is optional kept or left out; files are configuration."""
        if isinstance(x, list):
            return [self._resolved(y) for y in x]
        if not isinstance(x, dict) or "$const" in x:
            return x
        if "$include" in x:
            return self._resolved(self._included(x["$include"]))
        if "$optional" in x:
            inner = self._resolved(x["$optional"])
            asked = self._table_of(inner) if isinstance(inner, dict) else None
            return {"$const": None} if asked and asked != "nodes" and self._table(asked) is None else inner
        return {k: self._resolved(v) for k, v in x.items()}

    def _included(self, name: str):
        if not self.folder:
            raise ValueError(f"$include {name}: no folder is given")
        base = os.path.realpath(self.folder)
        path = os.path.realpath(os.path.join(base, name))
        if os.path.commonpath([base, path]) != base:
            raise ValueError(f"$include {name}: not in the folder")
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    @staticmethod
    def _table_of(expr: dict) -> str | None:
        for root in ROOTS:
            if root in expr:
                return str(expr[root]) if root == "$payload" else root[1:]
        return None

    def _table(self, name: str) -> DataFrame | None:
        if name == "nodes":
            return self.nodes
        if name == "edges":
            return self.edges.withColumns({"from": F.col("src"), "to": F.col("dst")})
        df = self.tables.get(name)
        if df is None or name != "lexicon" or "canonical" not in df.columns:
            return df
        # One row for each term, with the status and note of its least phrase.
        sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("phrase", "phrases"), ("target", "targets"))]
        least = F.min(F.struct("phrase", "status", "note")).alias("x")
        return df.groupBy(F.col("canonical").alias("term")).agg(*sets, least).select("term", "phrases", "targets", "x.status", "x.note")

    def _items(self, expr: dict) -> tuple[DataFrame, Column]:
        """The rows of a collection in its order, with ``_key`` for ties, and the value of an item."""
        name = self._table_of(expr)
        if name is None:
            raise ValueError(f"no collection in {expr}")
        rows = self._table(name)
        if rows is None:
            raise ValueError(f"no table {name} is given")
        if "$nodes" in expr:
            kinds = expr["$nodes"] if isinstance(expr["$nodes"], list) else [expr["$nodes"]]
            if kinds != ["*"]:
                if self.vocabulary is not None:
                    kinds = sorted({k for kind in kinds for k in self.vocabulary.covers(kind)})
                rows = rows.where(F.col("type").isin(*kinds))
        if not expr.get("$history") and "status" in rows.columns:
            rows = rows.where("coalesce(status, 'current') != 'superseded'")
        rows = self._where(rows, expr.get("$where"))
        rows = rows.withColumn("_key", F.col("id") if "id" in rows.columns else F.to_json(F.struct(*rows.columns)))
        order = self._order(rows, expr.get("$sort"))
        if order or "$limit" in expr:
            rows = rows.orderBy(*order, "_key")
        if "$limit" in expr:
            rows = rows.limit(int(expr["$limit"]))
        return self._shape(rows, expr)

    def _leaves(self, x, path: str):
        """(path, expression) of each collection, count, first item or constant of a document."""
        if isinstance(x, dict) and "$graph" in x:
            for name in ["nodes", *sorted({"edges", *self.tables})]:
                yield (f"{path}.{name}" if path else name), {"$nodes": ["*"], "$history": True} if name == "nodes" else {"$payload": name, "$history": True}
        elif isinstance(x, dict) and not any(k.startswith("$") for k in x):
            for k, y in x.items():
                yield from self._leaves(y, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                yield from self._leaves(y, f"{path}[{i}]")
        else:
            yield path, x

    def _part(self, path: str, x) -> DataFrame:
        place, none = F.lit(path).alias("path"), F.lit(None).cast("string").alias("key")
        spark = self.nodes.sparkSession
        if isinstance(x, dict) and "$const" not in x:
            if "$count" in x:
                rows, _ = self._items(x["$count"])
                return rows.agg(F.count("*").alias("n")).select(place, none, F.lit(None).cast("long").alias("no"), F.col("n").cast("string").alias("value"))
            if "$first" in x:
                x = x["$first"] | {"$limit": 1}
            rows, value = self._items(x)
            key = self._path(rows, x["$group"]).text.alias("key") if "$group" in x else none
            if "$limit" in x:  # so few that one task may number them
                order = self._order(rows, x.get("$sort"))
                no = F.row_number().over(Window.orderBy(*order, "_key")).cast("long")
            else:
                no = F.monotonically_increasing_id()
            plain = dict(rows.select(value.alias("v")).dtypes)["v"]
            nested = plain.startswith(("struct", "array", "map"))
            said = F.to_json(value if nested else F.struct(value.alias("v")), {"ignoreNullFields": "false"})
            if not nested:  # a bare value as it stands in an object of its own
                said = F.regexp_extract(said, r'(?s)^\{"v":(.*)\}$', 1)
            return rows.select(place, key, no.alias("no"), said.alias("value"))
        value = json.dumps(x["$const"] if isinstance(x, dict) else x, ensure_ascii=False)
        return spark.createDataFrame([(path, None, None, value)], "path string, key string, no long, value string")

    # Fields.

    @staticmethod
    def _path(rows: DataFrame, name: str) -> Value:
        name = name.lstrip("$")
        if name.startswith("attr.") and "attributes" in rows.columns:
            return attribute(name[5:], "attributes")
        if name == "attrs":
            return of_text(F.coalesce(F.col("attributes"), F.lit("{}")))
        if name in EDGE_FIELDS and f"_{name}" in rows.columns:
            name = f"_{name}"
        known = name.split(".")[0] in rows.columns
        return of_text(F.col(name).cast("string") if known else F.lit(None).cast("string"))

    def _where(self, rows: DataFrame, where: dict | None) -> DataFrame:
        for name, want in (where or {}).items():
            if name in rows.columns and dict(rows.dtypes)[name].startswith("array"):
                js = F.to_json(name)
                v = Value(js, js)
            else:
                v = self._path(rows, name)
            if not isinstance(want, dict):
                rows = rows.where(compare("=", v, want))
                continue
            for op, x in want.items():
                if op == "$ne":
                    rows = rows.where(~compare("=", v, x))
                else:
                    rows = rows.where(compare({"$in": "in", "$exists": "exists", "$contains": "contains"}[op], v, x))
        return rows

    def _keys(self, rows: DataFrame, spec) -> list[tuple[Column, bool]]:
        """(key, whether it falls): numbers before texts; nulls last, or first where the order is reversed."""
        out = []
        for one in [] if spec is None else spec if isinstance(spec, list) else [spec]:
            v, down = self._path(rows, one.lstrip("-+")), one.startswith("-")
            out += [(v.text.isNull().cast("int"), down), (F.when(v.numeric, v.number), down), (v.text, down)]
        return out

    def _order(self, rows: DataFrame, spec) -> list[Column]:
        return [k.desc_nulls_last() if down else k.asc_nulls_last() for k, down in self._keys(rows, spec)]

    # Shapes.

    def _shape(self, rows: DataFrame, expr: dict) -> tuple[DataFrame, Column]:
        for key in ("$map", "$field", "$select"):
            if key in expr:
                return self._value(rows, expr[key])
        return rows, F.struct(*(F.col(c) for c in rows.columns if not c.startswith("_")))

    def _value(self, rows: DataFrame, x) -> tuple[DataFrame, Column]:
        """The rows, with joined columns where neighbours are asked for, and the value as a column."""
        if isinstance(x, str):
            if x == "$row":
                return rows, F.struct(*(F.col(c) for c in rows.columns if not c.startswith("_")))
            if x.startswith("$") and dict(rows.dtypes).get(x[1:], "").startswith(("array", "struct", "map")):
                return rows, F.col(x[1:])
            return rows, self._path(rows, x).text if x.startswith("$") else F.lit(x)
        if not isinstance(x, (dict, list)):
            return rows, F.lit(x)
        if isinstance(x, list):
            parts = []
            for y in x:
                rows, c = self._value(rows, y)
                parts.append(c)
            return rows, F.array(*parts)
        if "$const" in x:
            return rows, F.lit(x["$const"])
        if "$out" in x or "$in" in x:
            return self._neighbours(rows, x)
        if "$count" in x:
            rows, c = self._value(rows, x["$count"])
            return rows, F.size(c).cast("long")
        if "$first" in x:
            rows, c = self._value(rows, x["$first"])
            return rows, F.try_element_at(c, F.lit(1))
        if "$concat" in x:
            parts = []
            for y in x["$concat"]:
                rows, c = self._value(rows, y)
                parts.append(F.coalesce(c.cast("string"), F.lit("")))
            return rows, F.concat(*parts)
        if "$format" in x:
            parts = re.split(r"\{([^}]*)\}", x["$format"])
            return rows, F.concat(*(F.coalesce(self._path(rows, p).text, F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))
        if any(k.startswith("$") for k in x):
            raise ValueError(f"unknown operator in {x}")
        fields = []
        for k, y in x.items():
            rows, c = self._value(rows, y)
            fields.append(c.alias(k))
        return rows, F.struct(*fields)

    def _neighbours(self, rows: DataFrame, x: dict) -> tuple[DataFrame, Column]:
        """The values of a node's neighbours as an array, gathered by one join and one aggregation."""
        mine, other, rels = ("src", "dst", x.get("$out")) if "$out" in x else ("dst", "src", x.get("$in"))
        rels = rels if isinstance(rels, list) else [rels]
        e = self.edges if rels == ["*"] else self.edges.where(F.col("rel").isin(*rels))
        n = self.nodes
        if not x.get("$history"):
            e, n = (df.where("coalesce(status, 'current') != 'superseded'") for df in (e, n))
        if x.get("$derived") == "exclude":
            e = e.where("coalesce(status, 'current') != 'derived'")
        n = self._where(n, x.get("$where"))
        shown = x.get("$map", x.get("$field", x.get("$select", "$id")))
        e = e.select(F.col(mine).alias("_mine"), F.col(other).alias("_other"), F.col("rel").alias("_rel"), F.col("derived_by").alias("_derived_by"), F.col("status").alias("_edge_status"))
        keys = self._keys(n, x.get("$sort"))
        n = n.withColumns({f"_s{i}": k for i, (k, _) in enumerate(keys)}).withColumnRenamed("id", "_oid").withColumn("id", F.col("_oid"))
        by_edge = bool(set(_paths(shown)) & {f"${f}" for f in EDGE_FIELDS})
        if not by_edge:  # once for each node, however many edges lead to it
            n, value = self._value(n, shown)
            n = n.select("_oid", value.alias("_v"), *(f"_s{i}" for i in range(len(keys))))
        pairs = e.join(n, F.col("_other") == F.col("_oid"))
        if by_edge:
            pairs, value = self._value(pairs, shown)
            pairs = pairs.withColumn("_v", value)
        value = F.col("_v")
        if x.get("$derived") == "mark":
            object_ = dict(pairs.dtypes)["_v"].startswith("struct")
            value = value.withField("derived_by", F.col("_derived_by")) if object_ else F.struct(value.alias("value"), F.col("_derived_by").alias("derived_by"))
        out = f"_n{len(rows.columns)}"
        falls = [down for _, down in keys]
        sort = F.struct(*(f"_s{i}" for i in range(len(keys))), F.col("_oid").alias("_s_id"), F.col("_rel").alias("_s_rel")).alias("sort")
        items = F.collect_list(F.struct(sort, value.alias("v")))
        items = F.array_sort(items, lambda a, b: _before(a["sort"], b["sort"], falls))
        items = F.transform(items, lambda r: r["v"])
        if "$limit" in x:
            items = F.slice(items, 1, int(x["$limit"]))
        found = pairs.groupBy("_mine").agg(items.alias(out))
        rows = rows.join(found, rows["id"] == found["_mine"], "left").drop("_mine")
        none = F.array().cast(dict(found.dtypes)[out])
        return rows, F.coalesce(F.col(out), none)


def _before(a: Column, b: Column, falls: list[bool]) -> Column:
    """-1, 0 or 1: how two items stand by their keys, then by id and relation; nulls stand last."""
    out = F.lit(0)
    for i, down in reversed([*((f"_s{i}", d) for i, d in enumerate(falls)), ("_s_id", False), ("_s_rel", False)]):
        x, y = a[i], b[i]
        less = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, 1 if down else -1).when(x > y, -1 if down else 1).otherwise(0)
        out = F.when(less != 0, less).otherwise(out)
    return out


def _paths(x):
    if isinstance(x, str):
        yield x
        yield from (f"${p}" for p in re.findall(r"\{([^}]*)\}", x))
    elif isinstance(x, dict):
        for k, y in x.items():
            if k in ("$out", "$in", "$const"):  # neighbours of the neighbours have edges of their own
                return
            yield from _paths(y)
    elif isinstance(x, list):
        for y in x:
            yield from _paths(y)


def references(expr) -> dict:
    """{classes, relations, attributes} that a projection names, to check it against a vocabulary.

    Where there are any, also includes (files, which have references of their
    own) and optional (classes and relations that need not be declared).
    """
    out: dict = {"classes": set(), "relations": set(), "attributes": set()}
    loose: dict = {"classes": set(), "relations": set()}
    files: set[str] = set()

    def listed(v):
        return v if isinstance(v, list) else [v]

    def walk(x, named):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == "$nodes":
                    named["classes"] |= {c for c in listed(v) if c != "*"}
                elif k in ("$out", "$in") and not isinstance(v, dict):
                    named["relations"] |= {r for r in listed(v) if r != "*"}
                elif k == "$include":
                    files.add(v)
                elif k.startswith("attr."):
                    out["attributes"].add(k[5:])
                walk(v, loose if k == "$optional" else named)
        elif isinstance(x, list):
            for y in x:
                walk(y, named)
        elif isinstance(x, str) and x.startswith("$attr."):
            out["attributes"].add(x[6:])

    walk(expr, out)
    return out | ({"includes": files} if files else {}) | ({"optional": loose} if any(loose.values()) else {})
