"""Projections: collections, includes, orders, and documents of several parts."""

import json

import pytest

from kgspark.plans.projection import Projection, references
from kgspark.plans.vocabulary import Vocabulary
from tests.test_graph import graph, node


def _payload(spark):
    n, e = graph(
        spark,
        [node("a", "Role", '{"tier": 2}'), node("b", "Role", '{"tier": 10}'), node("c", "Team"), node("d", "Lead", '{"tier": 1}'), node("o", "Role", status="superseded"), node("z", "Role")],
        [("a", "in", "c"), ("b", "in", "c"), ("d", "leads", "c"), ("z", "in", "c")],
    )
    tables = {
        "lexicon": spark.createDataFrame([("x", "XX", "a", "accepted", None), ("x", "X X", "b", "proposed", "n"), ("y", "Y", None, "accepted", None)], "canonical string, phrase string, target string, status string, note string"),
        "findings": spark.createDataFrame([("f1", "blocking"), ("f2", "minor")], "id string, severity string"),
    }
    return Projection(n, e, tables, Vocabulary({"Role": {}, "Lead": {"subclass_of": "Role"}}))


def _rows(df):
    return sorted(((r["path"], r["key"], r["value"]) for r in df.collect()), key=repr)


def test_collections(spark):
    p = _payload(spark)
    values = lambda x: [r["value"] for r in p.run(x).collect()]
    assert values({"$nodes": "Role", "$sort": "-attr.tier", "$map": "$id"}) == ["z", "b", "a", "d"]  # subclasses, numbers as numbers, nulls first when reversed
    assert values({"$nodes": "Role", "$sort": "attr.tier", "$limit": 2, "$map": "$id"}) == ["d", "a"]
    assert values({"$lexicon": True, "$sort": "term", "$map": {"$format": "{term}:{status}"}}) == ["x:proposed", "y:accepted"]
    assert [tuple(v["phrases"]) for v in values({"$lexicon": True, "$sort": "term"})] == [("X X", "XX"), ("Y",)]
    assert values({"$findings": True, "$where": {"severity": "blocking"}, "$map": "$id"}) == ["f1"]
    assert sorted(values({"$edges": True, "$where": {"rel": "leads"}, "$map": {"$format": "{from}>{to}{gone}"}})) == ["d>c"]
    assert values({"$payload": "findings", "$sort": "-id", "$map": "$id"}) == ["f2", "f1"]
    with pytest.raises(ValueError):
        p.run({"$ledger": True})


def test_neighbours(spark):
    p = _payload(spark)
    team = {
        "who": {"$in": "in", "$sort": "-attr.tier", "$map": "$id"},
        "two": {"$in": "*", "$sort": "attr.tier", "$limit": 2, "$map": {"$concat": ["$rel", " ", "$id"]}},
        "marked": {"$in": "leads", "$derived": "mark", "$select": {"id": "$id"}},
        "plain": {"$in": "leads", "$derived": "mark"},
    }
    got = p.run({"$nodes": "Team", "$select": team}).first()["value"].asDict(recursive=True)
    assert got["who"] == ["z", "b", "a"] and got["two"] == ["leads d", "in a"]
    assert got["marked"] == [{"id": "d", "derived_by": None}] and got["plain"] == [{"value": "d", "derived_by": None}]


def test_assembled(spark, tmp_path):
    p = _payload(spark)
    (tmp_path / "roles.json").write_text(json.dumps({"$nodes": "Role", "$group": "type", "$map": "$id"}))
    p.folder = str(tmp_path)
    doc = {
        "title": "Roles", "n": {"$count": {"$nodes": "Role"}}, "by": {"kind": {"$include": "roles.json"}}, "none": {"$optional": {"$ledger": True}},
        "best": {"$first": {"$nodes": "Role", "$sort": "attr.tier", "$select": {"id": "$id", "gone": "$gone"}}}, "list": [{"$const": [1, None]}, {"$findings": True, "$map": "$severity"}],
    }
    want = [("best", None, '{"id":"d","gone":null}'), ("list[0]", None, "[1, null]"), ("list[1]", None, '"blocking"'), ("list[1]", None, '"minor"'), ("n", None, "4"), ("none", None, "null"), ("title", None, '"Roles"')]
    want += [("by.kind", "Role", f'"{x}"') for x in "abz"] + [("by.kind", "Lead", '"d"')]
    assert _rows(p.assembled(doc)) == sorted(want, key=repr)
    order = p.assembled({"x": {"$nodes": ["*"], "$sort": "-label", "$map": "$id"}}).orderBy("no").collect()
    assert [r["value"] for r in order] == ['"z"', '"d"', '"c"', '"b"', '"a"']
    assert {r["path"] for r in p.assembled({"$graph": True}).select("path").distinct().collect()} == {"nodes", "edges", "lexicon", "findings"}
    with pytest.raises(ValueError):
        p.run({"$include": "../other.json"})


def test_references():
    got = references({"a": {"$include": "x.json"}, "b": {"$optional": {"$nodes": "Ghost", "$map": {"$out": "haunts"}}}, "c": {"$nodes": "Role", "$where": {"attr.k": 1}}})
    assert got == {"classes": {"Role"}, "relations": set(), "attributes": {"k"}, "includes": {"x.json"}, "optional": {"classes": {"Ghost"}, "relations": {"haunts"}}}
