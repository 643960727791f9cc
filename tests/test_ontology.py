"""Vocabularies written as Turtle and read again, and read from tables."""

from kgspark.plans.vocabulary import Vocabulary, diff
from kgspark.queries import VOCABULARY
from kgspark.sources import ontology

HARD = Vocabulary(
    {
        "A b": {"label": 'Say "A"; then, [b] (c).', "definition": "one\ntwo # three", "alt_labels": ["x", "y z"], "was": ["Old A"]},
        "C.d": {"subclass_of": ["A b"], "requires": ["r-1"], "attributes": {"é.n": {"type": "enum:u v|w", "required": True}, "p": {"pattern": '^"\\d+"$'}, "q": {"type": "number", "min_value": 0}, "s": {"type": "scheme:S 1"}}},
    },
    {"r-1": {"domain": ["A b", "C.d"], "range": ["C.d"], "min": 1, "max": 2, "inverse": "of"}, "r2": {"subproperty_of": ["r-1"], "definition": "d"}},
    {"S 1": {"a.b": {"broader": "c"}, "c": {"label": "C"}}, "empty": {}},
)


def test_round_trip(spark, tmp_path):
    for i, v in enumerate((HARD, VOCABULARY, Vocabulary())):
        (tmp_path / f"{i}.ttl").write_text(ontology.turtle(v), encoding="utf-8")
        facts = ontology.read_turtle(spark, str(tmp_path / f"{i}.ttl"))
        assert {(r["subject"], r["predicate"], r["object"]) for r in facts.collect()} == set(ontology.statements(v))
        assert ontology.problems(facts).count() == 0
        back = ontology.vocabulary_of(facts)
        assert [d for d in diff(v, back) if not d[2].startswith("type enum")] == [] and [d for d in diff(back, v) if not d[2].startswith("type enum")] == []
    assert ontology.vocabulary_of(ontology.read_turtle(spark, str(tmp_path / "0.ttl"))) == HARD


def test_statements_of_others(spark):
    text = "# note\n@prefix ex: <http://x/> .\nex:A a owl:Class ; rdfs:label \"A.\"@en , \"B; c\"@fr .\nex:p a owl:ObjectProperty ; rdfs:domain ex:A ; rdfs:range [ a owl:Class ] .\n\n"
    facts = ontology.triples(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "file string, text string"))
    got = {(r["subject"], r["predicate"], r["object"]) for r in facts.collect()}
    assert {("ex:A", "a", "owl:Class"), ("ex:A", "rdfs:label", '"A."@en'), ("ex:A", "rdfs:label", '"B; c"@fr'), ("ex:p", "rdfs:domain", "ex:A")} <= got
    assert {r["subject"] for r in ontology.problems(facts).collect()} == {"ex:p"}


def test_tables_and_json(spark, tmp_path):
    (tmp_path / "v.csv").write_text('kind,name,description,domain,range,inverse\nclass,A,"An ""A"",\nof two lines",,,\nRelation,r,d,A|B,B,of\nproperty,r,,A,C,\nattribute,n,,A,number,\nattribute,m,,,,\nrelation,s,,,,\nthing,t,,,,\nclass,,,,,\n')
    v, notes = ontology.read_csv(spark, str(tmp_path / "v.csv"))
    assert v.classes == {"A": {"definition": 'An "A",\nof two lines', "attributes": {"n": {"type": "number"}}}}
    assert v.properties == {"r": {"definition": "d", "domain": ["A", "B"], "range": ["B", "C"], "inverse": "of"}}
    assert notes == ["attribute m without a domain", "a class without a name", "relation s without a domain", "t: thing is no kind of term"]
    assert {"r: domain B is not declared", "r: range C is not declared"} <= set(ontology.import_problems(v))
    j = ontology.read_json('{"classes": {"A": {"attributes": {"x": {}}}}, "attributes": {"A": {"y": {"type": "date"}}}, "schemes": {"s": {"concepts": {"k": {}}}}}')
    assert set(j.attributes("A")) == {"x", "y"} and j.schemes == {"s": {"k": {}}} and ontology.import_problems(Vocabulary()) == ["no classes"]


def test_terms_said_often_are_gathered_once(spark, monkeypatch):
    """Of a row for each use only the different ones reach the arrays of domains and ranges."""
    rows = spark.range(3000).selectExpr("'relation' kind", "'of' name", "concat('d', id % 7) description", "concat(id % 2, '|b') domain", "'r' range")
    plans, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    v, notes = ontology.vocabulary_of_rows(rows)
    assert v.properties == {"of": {"definition": "d0", "domain": ["0", "1", "b"], "range": ["r"]}} and not notes
    assert plans[0].count("Aggregate [") == 2  # domains and ranges as they are said, then terms
