"""Acronyms spelled out, briefs of documents, and changes of a vocabulary with what they touch."""

import duckdb
from pyspark.sql import functions as F

from kgspark import queries
from kgspark.operators import curation, survey
from kgspark.plans import vocabulary
from kgspark.plans.vocabulary import Vocabulary

EXPANSIONS = [
    ("ahead", "We met the Board of Trade (BT) in May.", {("BT", "Board of Trade")}),
    ("every word", "A State of Play (SOP) was drawn.", {("SOP", "State of Play")}),
    ("inside", "The BT (board of trade) met.", {("BT", "board of trade")}),
    ("fewest words", "Big Trade big trade (BT).", {("BT", "big trade")}),
    ("digits aside", "A Fast Track (FT2) began.", {("FT2", "Fast Track")}),
    ("second time", "We saw one (FT) and then a Fast Track (FT).", {("FT", "Fast Track")}),
    ("first form counts", "A Fast Track (FT).\nA Far Tower (FT).", {("FT", "Fast Track")}),
    ("connector first", "They are of trade (OT) men.", set()),
    ("nothing ahead", "(FT)", set()),
    ("too long", "One two three four five six seven eight nine (OTTFFSSEN).", set()),
    ("numbers are no words", "Nothing but 12 (NB) here.", {("NB", "Nothing but")}),
    ("no letters match", "A slow walk (FT) and FT (a slow walk).", set()),
    ("empty", "", set()),
    ("null", None, set()),
]


def test_expansions(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in EXPANSIONS], "doc_id string, text string")
    got = {}
    for r in survey.expansions(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["acronym"], r["long_form"]))
    assert got == {k: want for k, _, want in EXPANSIONS if want}
    assert survey.expansions(docs.limit(0)).count() == 0


def test_acronyms_of_all_letters(spark, tmp_path):
    """The query against its SQL over every pair of letters in each of its seven texts."""
    orders = spark.range(7 * 26 * 26).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("cust")).toDF("o_orderkey", "o_custkey")
    customer = spark.createDataFrame([(1, "AUTOMOBILE"), (2, "MACHINERY"), (3, None)], "c_custkey long, c_mktsegment string")
    con = duckdb.connect()
    for name, rows in (("orders", orders), ("customer", customer)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    ours = queries.QUERIES["acronym_expansions"](spark, str(tmp_path)).select("key", "acronym", "long_form").collect()
    theirs = con.execute(f"SELECT key, acronym, long_form FROM ({queries.SQL['acronym_expansions']})").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)


def test_brief_names_what_the_graph_holds(spark):
    docs = spark.createDataFrame([(1, "It is for the Claims Manager. They saw Claims Managers met AB-12 today."), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("role.b", "claims manager"), ("role.a", "Claims Manager"), ("x", None), ("role.b", "Claims Manager")], "id string, name string")
    rows = {(r["kind"], r["term"]): (r["rank"], r["count"], r["ids"]) for r in survey.brief(docs, names).collect()}
    assert rows[("phrase", "Claims Manager")] == (1, 2, ["role.a", "role.b"]) and rows[("code", "AB-12")] == (1, 1, [])


def test_changes_through_hierarchies(spark):
    old = Vocabulary({"A": {}, "B": {}}, {"p": {"domain": "A"}, "q": {"subproperty_of": "p", "inverse": "r"}, "t": {"domain": "A"}}, {"s": {"x": {"broader": "y"}, "y": {}}})
    new = Vocabulary({"A1": {"was": "A"}, "B": {"attributes": {"c": {"type": "scheme:s"}, "e": {"type": "enum:u|v"}}}}, {"p": {"domain": "A1"}, "q": {}, "t": {"domain": "A1|B"}}, {"s": {"x": {}, "y": {}}})
    kinds = set(vocabulary.diff(old, new))
    assert {("cosmetic", "p", "domain renamed"), ("breaking", "t", "domain changed"), ("breaking", "q", "superproperty removed"), ("additive", "q", "inverse changed"), ("additive", "s:x", "broader changed")} <= kinds
    nodes = spark.createDataFrame(
        [("1", "B", '{"c": "x", "e": "u"}'), ("2", "B", '{"c": "y", "e": "w"}'), ("3", "A1", '{"c": "x"}'), ("4", "B", None), ("5", "B", '{"c": "", "e": null}')], "id string, type string, attributes string"
    )
    edges = spark.createDataFrame([("p",), ("q",), (None,)], "rel string")
    changes = [("concept removed", "s.x"), ("scheme removed", "s"), ("attribute values removed", "B.e"), ("superproperty removed", "p"), ("class removed", "gone")]
    got = {(r["kind"], r["subject"]): r["affected"] for r in curation.impact(changes, nodes, edges, new).collect()}
    assert list(got.values()) == [got[c] for c in got] and [got[c] for c in changes] == [1, 2, 1, 1, 0]
