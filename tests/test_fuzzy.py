"""Substrings both ways against a comparison of all pairs."""

import random

import pytest

from kgspark.operators import fuzzy


def table(spark, rows, name):
    return spark.createDataFrame(list(enumerate(rows)), f"{name} long, t string")


@pytest.mark.parametrize("spread", [1000, 2])
def test_contained(spark, monkeypatch, spread):
    monkeypatch.setattr(fuzzy, "SPREAD", spread)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcA %_é") for _ in range(n))
    short = [word(rng.randint(0, 5)) for _ in range(60)] + [None, "", "zz", "abcabcabcabc", "😀"]
    long = [word(rng.randint(0, 30)) for _ in range(80)] + [None, "", "x" * 5000 + "zz", "a😀b"]
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    want = {(i, j) for i, s in enumerate(short) for j, t in enumerate(long) if s and t and fold(s) in fold(t)}
    found = fuzzy.contained(table(spark, short, "short_id"), table(spark, long, "long_id"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_lexicon_both_ways_and_limit(spark):
    lex = spark.createDataFrame([("press", "Press", f"m.{i}", None, None) for i in range(5)] + [("the press room", "Room", "r.1", "x", None)], "phrase string, canonical string, target string, status string, note string")
    terms = spark.createDataFrame([("a press here",), ("ess",), ("none",), (None,)], "term string")
    got = sorted((r["term"], r["target"]) for r in fuzzy.lexicon_fuzzy(lex, terms).collect())
    assert got == sorted([("a press here", f"m.{i}") for i in range(5)] + [("ess", f"m.{i}") for i in range(5)] + [("ess", "r.1")])
    few = sorted((r["term"], r["target"]) for r in fuzzy.lexicon_fuzzy(lex, terms, 2).collect())
    assert few == [("a press here", "m.0"), ("a press here", "m.1"), ("ess", "m.0"), ("ess", "m.1")]
    assert fuzzy.lexicon_fuzzy(lex.where("phrase = ''"), terms).count() == 0
