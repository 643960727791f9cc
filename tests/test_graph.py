"""Values, patterns, rules, shapes and changes on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark.functions.expressions import Value, attribute, compare, type_fits, valid_on
from kgspark.operators import curation, shapes, temporal
from kgspark.operators.graph import KnowledgeGraph
from kgspark.plans import questions, rules, vocabulary
from kgspark.plans.pattern import Matcher
from kgspark.plans.projection import Projection, references
from kgspark.plans.vocabulary import Vocabulary

NODE = "id string, type string, label string, status string, as_of string, valid_from string, valid_to string, source_doc string, supersedes array<string>, superseded_by string, summary string, attributes string, tags array<string>, sources array<string>"
EDGE = "src string, rel string, dst string, status string, derived_by string, premises array<string>"


def node(id, type="Thing", attributes="{}", status="current", label=None, **more):
    cols = ["as_of", "valid_from", "valid_to", "source_doc", "supersedes", "superseded_by", "summary"]
    return (id, type, label or id.upper(), status, *(more.get(c) for c in cols), attributes, more.get("tags") or [], more.get("sources") or [])


def graph(spark, nodes, edges=()):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, "current", None, []) for e in edges], EDGE)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("js, op, expected, want", [
    ('{"v": 3}', "=", 3, True), ('{"v": 3.0}', "=", 3, True), ('{"v": "3"}', "=", 3, False), ('{"v": true}', "=", 1, True), ('{"v": 1}', "!=", 2, True),
    ("{}", "!=", 2, False), ("{}", "not_in", [2], False), ("{}", "exists", False, True), ('{"v": ""}', "exists", True, False), ('{"v": []}', "exists", True, False),
    ('{"v": 0}', "exists", True, True), ('{"v": "12"}', "<", 100, True), ('{"v": "2024-05-01"}', "<", "2024-06-01", True), ('{"v": "x"}', "<", 5, False),
    ('{"v": "2025-05-20"}', ">", "$today-30d", True), ('{"v": ["a", "b"]}', "contains", "b", True), ('{"v": "abc"}', "contains", "bc", True), ('{"v": 5}', "contains", "5", False),
    ('{"v": "b"}', "in", ["a", "b"], True), ('{"v": null}', "=", "x", False), ('{"v": 10}', ">=", "9", True),
])
def test_compare(spark, js, op, expected, want):
    df = spark.createDataFrame([(js,)], "attributes string")
    assert df.select(compare(op, attribute("v"), expected)).first()[0] is want


@pytest.mark.parametrize("kind, js, want", [("integer", "3", True), ("integer", "3.5", False), ("number", "true", False), ("date", '"2024-01-01"', True), ("date", '"soon"', False), ("enum:a|b", '"b"', True), ("enum:a|b", '"c"', False), ("list", "[1]", True), ("string", '""', True), ("boolean", "false", True)])
def test_types(spark, kind, js, want):
    df = spark.createDataFrame([(f'{{"v": {js}}}',)], "attributes string")
    assert df.select(type_fits(kind, attribute("v"))).first()[0] is want


def test_valid_on_is_half_open(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "2024-02-01"), ("b", "2024-02-01", None), ("c", None, "2024-01-15")], "id string, valid_from string, valid_to string")
    assert [r["id"] for r in df.where(valid_on("2024-02-01")).collect()] == ["b"]


# A small matcher of our own, one binding at a time, to compare with.


def _match(nodes, edges, when, start=None):
    found = [dict(start or {})]
    for p in when:
        new = []
        for b in found:
            if "node" in p:
                for n, kind in [(b[p["node"]], nodes.get(b[p["node"]]))] if p["node"] in b else nodes.items():
                    if kind and (not p.get("type") or kind == p["type"]):
                        new.append({**b, p["node"]: n})
            elif "edge" in p or "not_edge" in p:
                s, r, d = p.get("edge") or p["not_edge"]
                hits = [(x, y) for x, rel, y in edges if (not r or rel in r.split("|")) and (s == "*" or b.get(s, x) == x) and (d == "*" or b.get(d, y) == y)]
                if "not_edge" in p:
                    new += [] if hits else [b]
                else:
                    new += [{**b, **({s: x} if s != "*" else {}), **({d: y} if d != "*" else {})} for x, y in hits]
            elif "not" in p:
                new += [] if _match(nodes, edges, p["not"], b) else [b]
            elif "optional" in p:
                new += _match(nodes, edges, p["optional"], b) or [b]
        found = new
    return found


@pytest.mark.parametrize("seed", range(4))
def test_patterns_at_random(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(8)]
    kinds = {i: rng.choice("AB") for i in ids}
    edges = sorted({(rng.choice(ids), rng.choice(["r", "s"]), rng.choice(ids)) for _ in range(18)})
    m = Matcher(*graph(spark, [node(i, kinds[i]) for i in ids], edges))
    x, y, z = "xyz"
    for when in (
        [{"node": x, "type": "A"}, {"edge": [x, "r", y]}, {"node": y, "type": "B"}],
        [{"edge": [x, "r|s", y]}, {"edge": [y, "s", z]}, {"not_edge": [z, "r", x]}],
        [{"node": x, "type": "A"}, {"optional": [{"edge": [x, "r", y]}, {"node": y, "type": "A"}]}],
        [{"node": x}, {"not": [{"edge": [x, "s", y]}, {"edge": [y, "r", z]}]}],
        [{"edge": [x, "", y]}, {"optional": [{"edge": [y, "r", z]}]}, {"not": [{"edge": [y, "s", "*"]}]}],
        [{"node": x, "type": "B"}, {"not_edge": ["*", "r", x]}],
    ):
        select = sorted({v for b in _match(kinds, edges, when) for v in b} | {x})
        want = sorted({tuple(b.get(v) for v in select) for b in _match(kinds, edges, when)}, key=repr)
        assert got(m.select(m.match(when), [f"${v}" for v in select])) == want


def test_references_and_built_in_fields(spark):
    n, e = graph(spark, [node("a", "T", '{"k": "v1", "peer": "b"}'), node("b", "T", '{"k": "v1"}'), node("c", "T", '{"k": "v2"}')])
    m = Matcher(n, e)
    assert got(m.select(m.match([{"node": "x"}, {"node": "y", "where": {"id": "$x.peer"}}]), ["$x", "$y"])) == [("a", "b")]
    assert got(m.select(m.match([{"node": "x"}, {"node": "y", "where": {"k": "$x.k", "id": {"!=": "$x"}}}]), ["$x", "$y"])) == [("a", "b"), ("b", "a")]
    assert got(m.select(m.match([{"node": "x", "where": {"label": "C"}}]), ["$x", "$x.k"])) == [("c", "v2")]


def test_only_believed_facts_match(spark):
    n, e = graph(spark, [node("a"), node("b", status="superseded"), node("c", status="intended")], [("a", "r", "b"), ("a", "r", "c"), ("a", "r", "a")])
    assert got(Matcher(n, e).match([{"edge": ["x", "r", "y"]}])) == [("a", "a")]
    assert len(got(Matcher(n, e, statuses=("current", "intended")).match([{"edge": ["x", "r", "y"]}]))) == 2


def test_transitive_rule(spark):
    n, e = graph(spark, [node(x) for x in "abcde"], [("a", "reports_to", "b"), ("b", "reports_to", "c"), ("c", "reports_to", "d")])
    up = [
        {"id": "R1", "kind": "derive", "when": [{"edge": ["x", "reports_to", "y"]}, {"edge": ["y", "reports_to", "z"]}], "then": {"edge": ["x", "up", "z"]}},
        {"id": "R2", "kind": "derive", "when": [{"edge": ["x", "up", "y"]}, {"edge": ["y", "reports_to", "z"]}], "then": {"edge": ["x", "up", "z"]}},
    ]
    d = rules.derive(n, e, up)
    assert got(d.edges.select("src", "dst", "depth")) == [("a", "c", 1), ("a", "d", 2), ("b", "d", 1)]
    seen = KnowledgeGraph(n, e.unionByName(d.edges.drop("depth"))).explain("a", "up", "d")
    assert got(seen.select("level", "edge"))[0] == (0, "a -up-> d")
    with pytest.raises(ValueError):
        rules.derive(n, e, [{"id": "X", "kind": "derive", "when": [{"node": "x"}, {"not": []}], "then": {"attribute": ["x", "k", 1]}}])


def test_attributes_and_policies(spark):
    n, e = graph(spark, [node("p", "Claim", '{"amount": 12000}'), node("q", "Claim", '{"amount": 500, "high": false}'), node("s", "Claim", '{"amount": 20000}', status="intended")])
    rs = [
        {"id": "HIGH", "kind": "derive", "when": [{"node": "c", "type": "Claim", "where": {"amount": {">": 10000}}}], "then": {"attribute": ["c", "high", True]}},
        {"id": "P", "kind": "policy", "severity": "blocking", "when": [{"node": "c", "where": {"high": True}}], "then": {"flag": "look"}},
        {"id": "W", "kind": "policy", "when": [{"node": "c", "where": {"amount": {">": 1000}}}], "then": {"flag": "big"}},
    ]
    d = rules.derive(n, e, rs)
    assert got(d.attributes.select("node_id", "value")) == [("p", "true")]
    assert got(rules.policies(n, e, rs, derived=d)) == [("P", "blocking", "p", "look"), ("W", "warn", "p", "big"), ("W", "warn", "s", "big")]


def test_questions(spark):
    n, e = graph(spark, [node("m1", "Machine"), node("m2", "Machine"), node("s", "Site")], [("m1", "at", "s")])
    m = Matcher(n, e)
    q = {"params": {"M": {"type": "Machine"}}, "ask": {"when": [{"edge": ["$M", "at", "site"]}], "select": ["$site"]}, "gate": "non_empty"}
    assert questions.status(m, q, {"M": "m1"}) == "answered" and questions.status(m, q, {"M": "m2"}) == "unanswered"
    assert got(questions.survey(m, q)) == [("m1", 1, "answered"), ("m2", 0, "unanswered")]
    assert got(questions.brief(m, {"where": q}).select("subject", "status")) == [("m1", "READY"), ("m2", "BLOCKED")]


def test_shapes(spark):
    v = Vocabulary(
        {"Base": {"attributes": {"no": {"required": True}}}, "Pay": {"subclass_of": "Base", "attributes": {"sum": {"min_value": 1, "pattern": "^[0-9]+$"}}, "requires": ["of"]}},
        {"of": {"domain": "Pay", "max": 1}, "of_main": {"subproperty_of": "of", "domain": "Pay"}},
    )
    n, e = graph(spark, [node("a", "Pay", '{"no": "1", "sum": 5}'), node("b", "Pay", '{"sum": 0}'), node("c", "Base", '{"no": ""}')], [("a", "of", "c"), ("a", "of_main", "b")])
    assert got(shapes.findings(v, n, e).select("kind", "node_id", "subject")) == [("max", "a", "of"), ("required", "b", "no"), ("required", "c", "no"), ("requires", "b", "of"), ("value", "b", "sum")]


def test_vocabulary():
    v = Vocabulary({"A": {}, "B": {"subclass_of": "A"}, "C": {"subclass_of": ["B", "X"]}, "X": {"was": "Y"}}, {"p": {}, "q": {"subproperty_of": "p"}}, {"s": {"a": {"broader": "b"}, "b": {"broader": "c"}, "c": {}, "l": {"broader": "l"}}})
    assert v.covers("A") == {"A", "B", "C"} and v.relations_of("p") == ["p", "q"] and v.former_names() == {"Y": "X"}
    assert v.top_concepts("s") == {"a": "c", "b": "c", "c": "c", "l": "l"}
    new = Vocabulary({"A": {"attributes": {"k": {"required": True}}}, "B": {"subclass_of": "A"}, "C": {"subclass_of": ["B", "X"]}, "Z": {"was": "X"}}, {"p": {"max": 1}, "q": {"subproperty_of": "p"}}, v.schemes)
    kinds = {(s, x, c) for s, x, c in vocabulary.diff(v, new)}
    assert ("breaking", "A.k", "required attribute added") in kinds and ("breaking", "p", "max changed") in kinds and ("additive", "X", "class renamed to Z") in kinds
    assert vocabulary.composed([v, new]).classes["A"]["attributes"] == {"k": {"required": True}}


def test_supersession_chain_with_a_loop(spark):
    n, _ = graph(spark, [node("a", superseded_by="b"), node("b", superseded_by="c"), node("c"), node("x", superseded_by="y"), node("y", superseded_by="x"), node("d", superseded_by="gone")])
    assert got(temporal.chain(n)) == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0), ("d", "d", 0), ("x", None, None), ("y", None, None)]


def test_audit_chain(spark):
    import hashlib

    log, prev = [], ""
    for i in range(1, 6):
        prev = hashlib.sha256(f"{prev}|{i}|p{i}".encode()).hexdigest()
        log.append((i, f"p{i}" if i != 3 else "changed", prev))
    df = temporal.audit_chain(spark.createDataFrame(log, "seq long, payload string, hash string"))
    assert [r["seq"] for r in df.where("broken").collect()] == [3]


def test_candidate_checks(spark):
    live, _ = graph(spark, [node("a", attributes='{"k": 1}', source_doc="d", sources=["d"]), node("b")])
    cand, e = graph(spark, [node("a", attributes='{"k": 2}', source_doc="d", sources=["d"]), node("b", superseded_by="n"), node("n", as_of="soon", supersedes=["zz"]), node("n")], [("a", "r", "missing")])
    found = {(r["severity"], r["subject"], r["detail"]) for r in curation.check(live, cand, e).collect()}
    assert ("contradiction", "a", "changed without a supersession record") in found
    assert ("blocking", "n", "duplicate node id") in found and ("blocking", "n", "as_of is not a date") in found
    assert ("blocking", "n", "supersession points at an unknown id") in found and ("blocking", "a -r-> missing", "an end is unknown") in found
    assert ("blocking", "b", "has a successor but is not superseded") in found and ("gap", "n", "cites no source") in found


def test_merge(spark):
    nodes, _ = graph(spark, [node("a", attributes='{"k": "1"}', as_of="2024-01-01", sources=["x"]), node("b", label="Same")])
    new, _ = graph(spark, [node("a", attributes='{"k": "1", "m": "2"}', status=None, label="A"), node("c", label="same"), node("b", label="Other")])
    report = got(curation.merge(nodes, new).select("id", "outcome"))
    assert report == [("a", "updated"), ("b", "conflict"), ("c", "added")]
    assert got(curation.suspects(nodes, new)) == [("c", "b")]
    out = {r["id"]: r for r in curation.merged(nodes, new, "doc", "2025-01-01").collect()}
    assert set(out) == {"a", "b", "c"} and '"m"' in out["a"]["attributes"] and out["c"]["sources"] == ["doc"] and out["b"]["label"] == "Same"


def test_vetting(spark):
    n, e = graph(spark, [node("live", sources=["ok"]), node("pure", sources=["dead"], source_doc="dead"), node("mixed", sources=["ok", "dead"], source_doc="dead"), node("alone", sources=["dead2"]), node("mark", sources=["curation:x"])], [("pure", "r", "live")])
    ok = spark.createDataFrame([("ok",)], "source string")
    plan = curation.vet_plan(n, e, ok)
    assert got(plan.select("id", "action")) == [("alone", "orphaned"), ("mixed", "stripped"), ("pure", "resourced")]
    out = {r["id"]: (r["sources"], r["source_doc"], r["provenance"]) for r in curation.vet_rewrite(n, plan, ok, "2025-01-01").collect()}
    assert out["pure"] == (["ok"], "ok", "inferred") and out["mixed"] == (["ok"], "ok", None) and out["alone"][0] == ["dead2"]


def test_evidence(spark):
    docs = spark.createDataFrame([("d", "The press was moved\nto Site B, in 2024 for 1,250 euros.")], "doc string, text string")
    quotes = spark.createDataFrame([(1, "d", "press was moved to site b"), (2, "d", "The press … 2024"), (3, "d", "2024 … the press"), (4, "gone", "x"), (5, "d", "")], "id long, doc string, quote string")
    assert [r["held"] for r in curation.evidence_held(quotes, docs).orderBy("id").collect()] == [True, True, False, False, False]
    claims = spark.createDataFrame([(1, "d", 1250.0), (2, "d", 20.0)], "id long, doc string, value double")
    assert [r["stated"] for r in curation.numbers_stated(claims, docs).orderBy("id").collect()] == [True, False]


def test_projection(spark):
    n, e = graph(spark, [node("a", "Role", '{"tier": 2}'), node("b", "Role", '{"tier": 1}'), node("c", "Team"), node("o", "Role", status="superseded")], [("a", "in", "c"), ("b", "in", "c")])
    p = Projection(n, e)
    assert [r["value"] for r in p.run({"$nodes": "Role", "$sort": "attr.tier", "$map": "$label"}).collect()] == ["B", "A"]
    team = p.run({"$nodes": "Team", "$select": {"who": {"$in": "in", "$map": "$label"}, "n": {"$count": {"$in": "in"}}, "say": {"$format": "{id}: {label}"}}}).first()["value"]
    assert team["who"] == ["A", "B"] and team["n"] == 2 and team["say"] == "c: C"
    assert references({"$nodes": "Role", "$map": {"$out": "in", "$map": "$attr.tier"}}) == {"classes": {"Role"}, "relations": {"in"}, "attributes": {"tier"}}


def test_name_cascade(spark):
    n, e = graph(spark, [node("press", label="Press"), node("p2", label="press"), node("s", label="Site", status="superseded")])
    terms = spark.createDataFrame([("press",), ("PRESS",), ("the site",), ("nothing",)], "term string")
    lexicon = spark.createDataFrame([("the site", "s")], "phrase string, target string")
    assert got(KnowledgeGraph(n, e, lexicon=lexicon).match(terms)) == [("PRESS", "p2", 2, 2), ("PRESS", "press", 2, 2), ("press", "press", 1, 1), ("the site", "s", 3, 0)]


def test_value_of_derived_json(spark):
    from kgspark.functions.expressions import of_json

    df = spark.createDataFrame([('"x"',), ("3",), ("null",)], "v string")
    v: Value = of_json(F.col("v"))
    assert [tuple(r) for r in df.select(v.json, v.text).collect()] == [('"x"', "x"), ("3", "3"), (None, None)]
