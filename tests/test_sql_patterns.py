"""Patterns as joins against the same patterns as SQL, on Spark and on DuckDB, for random graphs and patterns."""

import json
import random

import duckdb
import pytest

from kgspark.plans import sql
from kgspark.plans.pattern import Matcher
from kgspark.plans.vocabulary import Vocabulary
from kgspark.schema import EDGES, NODES

VOCABULARY = Vocabulary(
    classes={"Thing": {}, "Machine": {"subclass_of": "Thing", "attributes": {"state": {"was": {"off": "idle"}, "default": "running"}}}, "Press": {"subclass_of": "Machine"}, "Site": {}},
    properties={"near": {}, "beside": {"subproperty_of": "near"}, "at": {}},
)


def node(i, kind, attributes, status="current", as_of=None):
    return (f"n{i}", kind, f"L{i % 4}", status, as_of, None, None, None, [], None, None, attributes if isinstance(attributes, str) else json.dumps(attributes), [], [], [])


def graph(spark, rng, n=14):
    kinds = ["Thing", "Machine", "Press", "Site", "Other"]
    value = lambda: rng.choice([1, 2, 2.0, True, "1", "two", "", None, [], ["a", "b"], "2024-01-05", "2024-02-05", {"x": 1}, "it's"])
    nodes = [node(i, rng.choice(kinds), {k: value() for k in ("state", "size", "mark") if rng.random() < 0.7}, rng.choice(["current"] * 5 + ["superseded", None, "intended"]), rng.choice([None, "2024-01-20"])) for i in range(n)]
    nodes.append(node(n, "Press", {"state": "off"}))
    edges = [(f"n{rng.randrange(n + 1)}", rng.choice(["near", "beside", "at"]), f"n{rng.randrange(n + 1)}", rng.choice(["current"] * 4 + ["superseded", None]), None, []) for _ in range(3 * n)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def block(rng, names, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        v = lambda: rng.choice(names)
        where = rng.choice([{}, {}, {"size": {"exists": rng.random() < 0.5}}, {"state": rng.choice(["idle", "running", "two"])}, {"size": {rng.choice(["<", ">=", "!=", "="]): rng.choice([1, 2, "2024-01-31", "two"])}},
                            {"mark": {"in": [1, "1", "two"]}}, {"mark": {"not_in": ["two", True]}}, {"mark": {"contains": "a"}}, {"id": {"!=": "$" + v()}}, {"size": {rng.choice(["=", "<", "!="]): f"${v()}.{rng.choice(['size', 'mark', 'label'])}"}},
                            {"label": f"L{rng.randrange(4)}"}, {"as_of": {"<": "2024-03-01"}}, {"label": "L$" + v()}])
        kind = rng.choice([{}, {"type": "Machine"}, {"type": "Thing|Site"}])
        edge = [rng.choice([v(), v(), "*"]), rng.choice(["near", "beside|at", "at", ""]), rng.choice([v(), v(), "*"])]
        choice = rng.random()
        if choice < 0.5:
            out.append({"edge": edge})
        elif choice < 0.7:
            out.append({"node": v(), **kind, "where": where})
        elif choice < 0.78:
            out.append({"not_edge": edge})
        elif choice < 0.84:
            out.append({"not_node": "z", **kind, "where": where})
        elif depth < 2:
            out.append({rng.choice(["not", "optional", "optional"]): block(rng, names + [f"i{depth}"], depth + 1)})
    return out


def of_duckdb(nodes, edges, text):
    con = duckdb.connect()
    con.register("nodes", nodes.toPandas())
    con.register("edges", edges.select("src", "rel", "dst", "status").toPandas())
    try:
        return sorted(map(tuple, con.sql(text).fetchall()), key=repr)
    finally:
        con.close()


def answers(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_random_patterns(spark, seed):
    """The joins and the text agree on DuckDB for every pattern, on Spark for some."""
    rng = random.Random(seed)
    nodes, edges = graph(spark, rng)
    nodes, edges = nodes.cache(), edges.cache()
    full = 0
    for k in range(7):
        when = [{"edge": ["a", rng.choice(["near", "at", "near|at"]), "b"]}, *block(rng, ["a", "b", "c"])]
        select = ["$a", "$b", "$c", "$a.state", "$c.label"]
        m = Matcher(nodes, edges, VOCABULARY)
        want = answers(m.select(m.match(when), select))
        text = sql.Renderer(VOCABULARY, columns=nodes.columns).query(when, select)
        assert of_duckdb(nodes, edges, text) == want, when
        if k == 0:
            assert answers(sql.run(nodes, edges, when, select, VOCABULARY)) == want, when
        full += bool(want)
    assert full


def test_relations_that_specialise(spark):
    nodes, edges = graph(spark, random.Random(1))
    text = sql.Renderer(VOCABULARY, expand=True).query([{"edge": ["a", "near", "b"]}], ["$a", "$b"])
    m = Matcher(nodes, edges, VOCABULARY)
    assert of_duckdb(nodes, edges, text) == answers(m.select(m.match([{"edge": ["a", "near|beside", "b"]}]), ["$a", "$b"]))


def test_loops_of_classes_end(spark):
    loop = Vocabulary(classes={"A": {"subclass_of": "B"}, "B": {"subclass_of": "A"}})
    nodes = spark.createDataFrame([node(1, "A", {}), node(2, "B", {}), node(3, "C", {})], NODES)
    edges = spark.createDataFrame([], EDGES)
    assert of_duckdb(nodes, edges, sql.Renderer(loop).query([{"node": "x", "type": "A"}], ["$x"])) == [("n1",), ("n2",)]
    assert answers(sql.run(nodes, edges, [{"node": "x", "type": "A"}], ["$x"], loop)) == [("n1",), ("n2",)]


@pytest.mark.parametrize("text", ["it's", "back\\slash", "\\'; DROP", "ünï"])
def test_quotes(spark, text):
    nodes = spark.createDataFrame([node(1, "A", {"k": text}), node(2, "A", {"k": "x"})], NODES)
    edges = spark.createDataFrame([], EDGES)
    when = [{"node": "x", "where": {"k": text}}]
    assert of_duckdb(nodes, edges, sql.Renderer().query(when, ["$x"])) == [("n1",)] == answers(sql.run(nodes, edges, when, ["$x"]))


def test_plan_of_many_optional_blocks_is_linear(spark):
    """Each further optional block and each later pattern on a variable of one adds a fixed number of scans."""
    nodes, edges = graph(spark, random.Random(2))

    def scans(n):
        when = [{"edge": ["a", "near", "b"]}]
        for i in range(n):
            when += [{"optional": [{"edge": ["b", "at", f"o{i}"]}]}, {"edge": ["a", "near", f"o{i}"]}]
        m = Matcher(nodes, edges, VOCABULARY)
        return str(m.match(when)._jdf.queryExecution().analyzed()).count("LogicalRDD")

    a, b, c = scans(1), scans(2), scans(3)
    assert c - b == b - a
