"""Versioned Parquet stores: write, commit, skip if unchanged, read back, verify.

A version is a folder of tables.  It counts once a commit names it: a file with
the next number, which only one writer can create.  Readers take the newest
commit, so a broken write is never seen; writers that were overtaken take the
number after, or give up if they said what they built on.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "version string, seq long, fingerprint string, at timestamp"
#: Versions that stay after a commit.
KEEP = 2
_T = TypeVar("_T")


class Conflict(RuntimeError):
    """Another version was committed meanwhile."""


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """Of the rows of all tables, in any order: counts and sums of row hashes."""
    parts = []
    for name, df in sorted(tables.items()):
        row = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
        n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
        parts.append(f"{name}:{n}:{total}")
    return "|".join(parts)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function to name files on it; any that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of commits, also of such as are being written; KEEP and a few at most."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/_commits")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def _claimed(spark: SparkSession, path: str, seq: int, row: dict) -> bool:
    """Creates the commit of that number, unless there is one."""
    fs, at = _files(spark, path)
    try:
        out = fs.create(at(f"{path}/_commits/{seq:012d}.json"), False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray((json.dumps(row) + "\n").encode()))
    out.close()
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    if not _numbers(spark, path):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).json(f"{path}/_commits").where("version IS NOT NULL")


def newest(spark: SparkSession, path: str):
    return commits(spark, path).orderBy(F.desc("seq")).first()


def publish(tables: dict[str, DataFrame], path: str, spark: SparkSession, base: str | None = None, keep: int = KEEP) -> str:
    """Write a new version and commit it, or return the newest one if its rows are the same.

    ``base`` is the version that the tables were made from: if it is not the
    newest any more, nothing is committed and Conflict is raised.  Without one
    the last writer's version is the newest.  ``keep`` versions stay.
    """
    mark = fingerprint(tables)
    version = None
    while True:
        last = newest(spark, path)
        if last and last["fingerprint"] == mark:
            if version:
                _drop(spark, path, version)
            return last["version"]
        if base is not None and (last is None or last["version"] != base):
            if version:
                _drop(spark, path, version)
            raise Conflict(f"built on {base}, the newest is {last and last['version']}")
        if version is None:
            version = uuid.uuid4().hex
            for name, df in tables.items():
                df.write.parquet(f"{path}/{version}/{name}")
            continue  # look again: writing takes a while
        seq = max([0, *_numbers(spark, path)]) + 1
        at = datetime.datetime.now(datetime.timezone.utc).isoformat()
        if _claimed(spark, path, seq, {"version": version, "seq": seq, "fingerprint": mark, "at": at}):
            retain(spark, path, keep)
            return version


def _drop(spark: SparkSession, path: str, name: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at(f"{path}/{name}"), True)


def retain(spark: SparkSession, path: str, keep: int = KEEP) -> list[str]:
    """Drops all versions but the newest ``keep``, each commit before its tables; returns what went."""
    old = [r for r in commits(spark, path).orderBy(F.desc("seq")).collect()][max(keep, 1) :]
    for r in old:
        _drop(spark, path, f"_commits/{r['seq']:012d}.json")
        _drop(spark, path, r["version"])
    return [r["version"] for r in old]


def read(spark: SparkSession, path: str, *names: str, version: str | None = None) -> dict[str, DataFrame]:
    """Tables of the newest committed version, or of the one named."""
    if version is None:
        row = newest(spark, path)
        if row is None:
            raise ValueError(f"{path} has no committed version")
        version = row["version"]
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in names}


def fresh(spark: SparkSession, path: str, version: str) -> bool:
    """Whether a version is the newest."""
    row = newest(spark, path)
    return row is not None and row["version"] == version


def with_snapshot(spark: SparkSession, path: str, names: list[str], work: Callable[[dict[str, DataFrame]], _T], tries: int = 3) -> _T:
    """What ``work`` makes of the newest version's tables.

    If files vanish under it because the version was dropped meanwhile, it is
    done again on the version that is newest then; any other error is raised.
    """
    for left in range(tries - 1, -1, -1):
        row = newest(spark, path)
        if row is None:
            raise ValueError(f"{path} has no committed version")
        try:
            return work(read(spark, path, *names, version=row["version"]))
        except Exception as e:
            gone = any(x in str(e) for x in ("PATH_NOT_FOUND", "FILE_NOT_EXIST", "FileNotFound", "does not exist", "UNABLE_TO_INFER_SCHEMA"))
            if not left or not gone or fresh(spark, path, row["version"]):
                raise
    raise AssertionError


def views(spark: SparkSession, path: str, *names: str, prefix: str = "") -> str:
    """Temporary views of the newest version's tables; returns the version."""
    row = newest(spark, path)
    if row is None:
        raise ValueError(f"{path} has no committed version")
    for name, df in read(spark, path, *names, version=row["version"]).items():
        df.createOrReplaceTempView(prefix + name)
    return row["version"]


def differences(written: DataFrame, back: DataFrame) -> DataFrame:
    """Rows of one side only, repeats counted: side is "missing" or "unexpected"."""
    back = back.select(*written.columns)
    return written.exceptAll(back).withColumn("side", F.lit("missing")).unionByName(back.exceptAll(written).withColumn("side", F.lit("unexpected")))


def drop_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the node and the edges at it."""
    return nodes.where(F.col("id") != node_id), edges.where((F.col("src") != node_id) & (F.col("dst") != node_id))


def write_layer(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph for other tools: ``nodes`` and ``edges`` as JSON lines, ``entities`` and ``relationships`` as CSV with a header."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    flat = lambda df, *columns: df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"')
    flat(nodes, "id", "type", "label", "status", "summary").csv(f"{path}/entities")
    flat(edges, "src", "rel", "dst", "status").csv(f"{path}/relationships")


# Renderings of a graph as rows.


def triples(nodes: DataFrame, edges: DataFrame, base: str = "urn:kg:") -> DataFrame:
    """(subject, line): the graph as N-Triples, one statement a row."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^A-Za-z0-9._~-]", "_"), F.lit(">"))
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    literal = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"'))
    fields = {"type": iri(F.col("type")), "label": literal(F.col("label")), "status": literal(F.col("status")), "as_of": literal(F.col("as_of"))}
    own = nodes.select(iri(F.col("id")).alias("subject"), F.explode(F.array(*(F.struct(F.lit(k).alias("p"), v.alias("o")) for k, v in fields.items()))).alias("x"))
    attrs = nodes.select(iri(F.col("id")).alias("subject"), F.explode(F.from_json("attributes", "map<string,string>")).alias("k", "v"))
    rows = own.select("subject", F.lit("").alias("ns"), F.col("x.p").alias("p"), F.col("x.o").alias("o")).union(
        attrs.select("subject", F.lit("attr/"), "k", literal(F.col("v")))
    )
    links = edges.select(iri(F.col("src")), F.lit("rel/"), "rel", iri(F.col("dst")))
    rows = rows.union(links).where(F.col("o").isNotNull())
    pred = F.concat(F.lit(f"<{base}"), "ns", F.regexp_replace("p", r"[^A-Za-z0-9._~-]", "_"), F.lit(">"))
    return rows.select("subject", F.concat_ws(" ", "subject", pred, "o", F.lit(".")).alias("line"))


def cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text, keywords): a node's own words and those of its neighbours, for search.

    Lines of neighbours are joined for each node, so hubs are long; a
    hub's lines are gathered by two-step aggregation.
    """
    both = edges.select(F.col("src").alias("id"), F.col("rel"), F.col("dst").alias("other")).union(
        edges.select(F.col("dst"), F.concat(F.lit("is "), "rel", F.lit(" of")), F.col("src"))
    )
    names = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    lines = both.join(names, "other").groupBy("id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "rel", "other_label"))).alias("lines"))
    out = nodes.join(lines, "id", "left")
    text = F.concat_ws("\n", F.concat(F.col("label"), F.lit(" ("), F.col("type"), F.lit(")")), "summary", F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"))
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2)))
    return out.select("id", text.alias("text"), words.alias("keywords"))
