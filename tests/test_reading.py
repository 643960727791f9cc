"""Readings of small graphs: what is visible, how terms are called, what phrases stand for, what bears on an entity."""

from kgspark.operators import reading
from kgspark.operators.graph import KnowledgeGraph
from kgspark.plans.vocabulary import Vocabulary, label, text_in
from kgspark.schema import EDGES, LEXICON, NODES

WORDS = Vocabulary(
    classes={"System": {"label": {"en": "system", "nl": "systeem"}, "definition": "what runs"}, "Service": {"subclass_of": "System", "attributes": {"state": {"type": "scheme:State"}}},
             "Decision": {}, "Document": {}, "CodeModule": {}},
    properties={"uses": {"inverse": "used_by", "inverse_label": {"nl": "gebruikt door"}}, "calls": {"subproperty_of": "uses", "inverse": "calledBy"}, "decided_in": {}},
    schemes={"State": {"open": {}, "new": {"broader": "open"}, "shut": {"label": {"nl": "dicht"}}}},
)


def _node(id, type="Service", status="current", attributes="{}", **more):
    cols = ("as_of", "valid_from", "valid_to", "source_doc", "supersedes", "superseded_by", "summary")
    return (id, type, more.get("label", id.upper()), status, *(more.get(c) for c in cols), attributes, [], [], more.get("evidence"))


def _graph(spark, lexicon=()):
    nodes = [
        _node("a", attributes='{"state": "new"}', source_doc="d1", evidence=[("d1", None, None), ("d2", None, None)]), _node("b", status="superseded", superseded_by="a", valid_to="2020-01-01"),
        _node("c", status=None, attributes='{"state": "open"}', valid_from="2021-01-01"), _node("s", "System"), _node("d", "Decision"), _node("document.d1", "Document"),
        _node("m", "CodeModule", attributes='{"path": "src/m"}'), _node("x", status="superseded", superseded_by="lost"),
    ]
    edges = [("a", "uses", "b", "current"), ("a", "calls", "c", "current"), ("a", "uses", "s", "superseded"), ("s", "calls", "a", None), ("a", "uses", "nowhere", "current"),
             ("a", "decided_in", "d", "current"), ("m", "uses", "a", "current"), ("a", "uses", "a", "current")]
    return KnowledgeGraph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, None, []) for e in edges], EDGES), WORDS, lexicon=spark.createDataFrame(list(lexicon), LEXICON))


def _ids(spark, *ids):
    return spark.createDataFrame([(x,) for x in ids], "id string")


def test_visibility(spark):
    g, ids = _graph(spark), _ids(spark, "a", "a", "missing", None)
    seen = lambda **how: sorted((r["direction"], r["rel"], r["other"]) for r in reading.relationships(g, ids, **how).collect())
    now = [("in", "calls", "s"), ("in", "uses", "a"), ("in", "uses", "m"), ("out", "calls", "c"), ("out", "decided_in", "d"), ("out", "uses", "a"), ("out", "uses", "nowhere")]
    assert seen() == now
    assert seen(history=True) == sorted([*now, ("out", "uses", "b"), ("out", "uses", "s")])
    assert seen(as_of="2019-06-01", rel="uses") == sorted([("in", "calls", "s"), ("in", "uses", "a"), ("in", "uses", "m"), *(("out", "uses", x) for x in ("a", "b", "nowhere", "s"))])
    assert reading.relationships(g, _ids(spark)).count() == 0


def test_labels(spark):
    assert label({"label": {"nl": "systeem"}}, "MySystem", "fr") == "systeem" and label(None, "MySystem_one") == "my system one"
    assert text_in("as it is", "nl") == "as it is" and text_in(None) == "" and text_in({"en": "", "nl": "x"}) == "x"
    assert reading.inverse_labels(WORDS, "nl") == {"uses": "gebruikt door", "calls": "called by"}
    said = {(r["direction"], r["rel"]): r["said"] for r in reading.relationships(_graph(spark), _ids(spark, "a"), language="nl").collect()}
    assert said[("in", "uses")] == "gebruikt door" and said[("out", "decided_in")] == "decided in"
    assert WORDS.find("systeem") == [("class", "System")] and WORDS.find("dicht") == [("concept", "State:shut")]


def test_definitions(spark):
    rows = {(r["kind"], r["name"]): r for r in reading.definitions(_graph(spark), "nl").collect()}
    counts = {k: (r["own"], r["covered"]) for k, r in rows.items()}
    assert counts[("class", "System")] == (1, 3) and counts[("class", "Service")] == (2, 2) and counts[("class", "Document")] == (1, 1)
    assert counts[("relation", "uses")] == (5, 7) and counts[("concept", "State:open")] == (1, 2) and counts[("concept", "State:shut")] == (0, 0)
    assert rows[("class", "System")]["said"] == "systeem" and rows[("class", "System")]["definition"] == "what runs" and rows[("concept", "State:shut")]["said"] == "dicht"


def test_stale(spark):
    got = {tuple(r) for r in reading.stale(_graph(spark).nodes).select("id", "superseded_by", "successor_status").collect()}
    assert got == {("b", "a", "current"), ("x", "lost", None)}


def test_resolve(spark):
    lexicon = [("the press", "Press", "a", "current", None), ("the press", "Press", "gone", "current", None), ("press room", "Room", None, "not_ingested", "asked")]
    terms = spark.createDataFrame([(" The Press",), ("see press room now",), ("C",), ("unheard of",), ("",), (None,)], "term string")
    got = {tuple(r) for r in reading.resolve(_graph(spark, lexicon), terms).select("term", "how", "canonical", "target", "status").collect()}
    assert got == {(" The Press", "phrase", "Press", "a", "current"), (" The Press", "phrase", "Press", "gone", None), ("see press room now", "substring", "Room", None, None), ("C", "name", None, "c", "current")}


def test_bearing(spark):
    g = _graph(spark, [("alpha", "Alpha", "a", "current", None), ("other", "Other", "s", "current", None)])
    got = {tuple(r) for r in reading.bearing(g, _ids(spark, "a"), "Decision", {"CodeModule": "path", "Document": None}).collect()}
    assert got == {
        ("a", "decision", "d", "decided_in", "out", "D"), ("a", "file", "m", "uses", "in", "src/m"), ("a", "phrase", "Alpha", None, None, "alpha"),
        ("a", "source", "document.d1", None, None, "d1"), ("a", "source", None, None, None, "d2"),
    }
