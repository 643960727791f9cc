"""Rules evaluated on what is new against rules evaluated on everything in each round."""

import random

import pytest

from kgspark.plans import rules
from kgspark.schema import EDGES, NODES


def graph(spark, n, edges):
    nodes = [(f"n{i}", "Thing", f"L{i}", "current", None, None, None, None, [], None, None, '{"size": %d}' % (i % 3), [], [], []) for i in range(n)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(f"n{a}", r, f"n{b}", "current", None, []) for a, r, b in edges], EDGES)


RULES = [
    {"id": "UP", "kind": "derive", "when": [{"edge": ["a", "reports_to", "b"]}], "then": {"edge": ["a", "above", "b"]}},
    {"id": "ALL", "kind": "derive", "when": [{"edge": ["a", "above", "b"]}, {"edge": ["b", "above", "c"]}], "then": {"edge": ["a", "above", "c"]}},
    {"id": "SIDE", "kind": "derive", "when": [{"edge": ["a", "above", "x"]}, {"node": "x", "where": {"size": 1}}, {"edge": ["y", "near", "c"]}, {"edge": ["x", "above|near", "y"]}], "then": {"edge": ["a", "near", "c"]}},
    {"id": "MARK", "kind": "derive", "when": [{"edge": ["a", "near", "c"]}, {"node": "c", "where": {"size": 2}}], "then": {"attribute": ["a", "mark", "$c.label"]}},
    {"id": "SPREAD", "kind": "derive", "when": [{"edge": ["a", "above", "b"]}, {"node": "b", "where": {"mark": {"exists": True}}}], "then": {"attribute": ["a", "mark", "$b.mark"]}},
    {"id": "LINK", "kind": "derive", "when": [{"node": "a", "where": {"mark": {"exists": True}}}, {"edge": ["a", "above", "b"]}], "then": {"edge": ["b", "marked_by", "a"]}},
]


@pytest.mark.parametrize("seed", [1])
def test_same_as_naive(spark, monkeypatch, seed):
    rng = random.Random(seed)
    n = 9
    edges = [(i, "reports_to", rng.randrange(i)) for i in range(1, n)] + [(rng.randrange(n), rng.choice(["near", "reports_to"]), rng.randrange(n)) for _ in range(5)]
    nodes, table = graph(spark, n, sorted(set(edges)))
    rows = lambda d: (sorted(map(repr, d.edges.collect())), sorted(map(repr, d.attributes.collect())))
    ours = rows(rules.derive(nodes, table, RULES))
    monkeypatch.setattr(rules, "_matched", lambda rule, m, news, since: m.match(rule["when"]))
    assert ours == rows(rules.derive(nodes, table, RULES))
    assert ours[0] and ours[1]


def test_rules_that_read_nothing_new_do_not_run(spark, monkeypatch):
    """A chain: after the first round only the closure runs, on new edges alone."""
    nodes, table = graph(spark, 9, [(i, "reports_to", i + 1) for i in range(8)])
    seen, inner = [], rules._matched

    def noted(rule, m, news, since):
        out = inner(rule, m, news, since)
        seen.append((rule["id"], since, out is not None))
        return out

    monkeypatch.setattr(rules, "_matched", noted)
    found = rules.derive(nodes, table, RULES[:2])
    assert found.edges.count() == 36
    assert [x for x in seen if x[0] == "UP"] == [("UP", None, True)] + [("UP", 0, False)] * (found.rounds - 1)
    assert all(ran for name, _, ran in seen if name == "ALL")
    for i, since in enumerate(s for n, s, _ in seen if n == "ALL"):
        assert (since is None) == (i == 0)
