"""Commits of several writers, readers of dropped versions, and candidates with undo."""

import threading

import pytest

from kgspark.operators import sessions
from kgspark.sources import store


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, label string, n long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_two_writers_never_share_a_number(spark, tmp_path):
    path, errors = f"{tmp_path}/s", []

    def write(i):
        try:
            store.publish({"t": table(spark, (f"w{i}", "x", i))}, path, spark, keep=10)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = store.commits(spark, path).orderBy("seq").collect()
    assert not errors and [r["seq"] for r in found] == [1, 2, 3, 4] and len({r["version"] for r in found}) == 4


def test_writer_that_was_overtaken(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    one = store.publish({"t": table(spark, ("a", "x", 1))}, path, spark)
    claimed, calls = store._claimed, []

    def slow(session, where, seq, row):
        if not calls:  # the other writer is faster by one number
            calls.append(seq)
            assert claimed(session, where, seq, {"version": "other", "seq": seq, "fingerprint": "f", "at": "2024-01-01T00:00:00"})
        return claimed(session, where, seq, row)

    monkeypatch.setattr(store, "_claimed", slow)
    with pytest.raises(store.Conflict):
        store.publish({"t": table(spark, ("b", "y", 2))}, path, spark, base=one)
    assert store.newest(spark, path)["version"] == "other"
    two = store.publish({"t": table(spark, ("b", "y", 2))}, path, spark)  # without a base: the number after
    assert [r["seq"] for r in store.commits(spark, path).orderBy("seq").collect()] == [2, 3] and store.fresh(spark, path, two)
    with pytest.raises(store.Conflict):
        store.publish({"t": table(spark, ("c", "z", 3))}, path, spark, base=one)


def test_readers_of_dropped_versions(spark, tmp_path):
    path, seen = f"{tmp_path}/s", []
    store.publish({"t": table(spark, ("a", "x", 1))}, path, spark)

    def work(tables):
        if not seen:  # two more versions while this one is read: it goes
            for i in (2, 3):
                store.publish({"t": table(spark, ("a", "x", i))}, path, spark)
        seen.append(1)
        return rows(tables["t"])

    assert store.with_snapshot(spark, path, ["t"], work) == [("a", "x", 3)] and len(seen) == 2
    with pytest.raises(ZeroDivisionError):
        store.with_snapshot(spark, path, ["t"], lambda t: 1 // 0)
    version = store.views(spark, path, "t", prefix="now_")
    assert rows(spark.table("now_t")) == [("a", "x", 3)] and store.fresh(spark, path, version)
    assert len(list((tmp_path / "s").iterdir())) == store.KEEP + 1


def test_session(spark):
    live = table(spark, ("a", "A", 1), ("b", "B", 2), ("c", None, None))
    s = sessions.Session(live, ["id"])
    put = table(spark, ("a", "A2", 1), ("d", "D", 4)).withColumn("_op", sessions.F.lit("put"))
    drop = table(spark, ("b", None, None)).withColumn("_op", sessions.F.lit("drop"))
    s.apply(put.union(drop))
    first = rows(s.candidate())
    assert first == sorted([("a", "A2", 1), ("c", None, None), ("d", "D", 4)], key=repr)
    s.apply(table(spark, ("a", "A3", 9), ("c", "C", 3)).withColumn("_op", sessions.F.lit("put")))
    after = s.candidate()
    undo = s.undo()
    assert rows(sessions.overlaid(after, undo, ["id"])) == first == rows(s.candidate())
    assert rows(sessions.overlaid(live, s.changes(), ["id"])) == first
    assert rows(sessions.overlaid(s.candidate(), s.undo(), ["id"])) == rows(live) == rows(s.candidate())
    with pytest.raises(ValueError):
        s.undo()
    with pytest.raises(ValueError):
        s.apply(put.union(put))
    s.apply(drop)
    s.abort()
    assert rows(s.candidate()) == rows(live)


def test_pending(spark):
    live = table(spark, ("a", "A", 1), ("b", "B", 2))
    put = lambda *r: table(spark, *r).withColumn("_op", sessions.F.lit("put"))
    drop = table(spark, ("b", "B", 2)).withColumn("_op", sessions.F.lit("drop"))
    got = sessions.pending(live, {"inbox": put(("a", "A2", 1), ("c", "C", 3), ("e", "E", 5)), "candidate": put(("c", "C", 3), ("b", "B", 2), ("a", "A3", 1)), "cuts": drop}, ["id"])
    assert rows(got) == sorted([
        ("a", "inbox", "changed", "clash"), ("a", "candidate", "changed", "clash"), ("c", "inbox", "added", "same"), ("c", "candidate", "added", "same"),
        ("e", "inbox", "added", "ready"), ("b", "candidate", "changed", "clash"), ("b", "cuts", "removed", "clash"),
    ], key=repr)
