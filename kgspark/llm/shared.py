"""What several of the operators need: the shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session of one machine (``local[...]``) that names none gets a folder in
    its warehouse; on a cluster the setting has to be there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has a column of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written once as Parquet to the shared folder and read back.

    Cuts the lineage in a way that outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, for tables that nothing reads any more: what was made of them has been written itself."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _told(edges: DataFrame):
    """What tells links (hi, lo) from others: their number and the sum of their hashes."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Alternates large-star and small-star steps, each a partial aggregation and a
    join on the node, until no link changes; the number of rounds grows with the
    logarithm of the longest path.  Nodes without a link are not returned.  Changes
    are told from the given links on, so stars take one round and no links none.

    No side of a join goes through the driver, however small Spark finds it, and
    minima are written before they are joined, so that Spark can split the links
    of one node.
    """
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    edges = written(edges, "edges")
    before, state = None, _told(edges)
    while state["n"] and state != before:
        # Only a node that is some link's hi has a smaller neighbour.
        low = written(edges.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        least = low.select(F.col("hi").alias("u"), "m").hint("merge")
        large = edges.join(least, edges["lo"] == least["u"], "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        large = written(large, "large")
        lower = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = large.join(lower.hint("merge"), "hi")
        both = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        after = written(small.select(F.explode(both).alias("e")).select("e.*").where("hi != lo").distinct(), "edges")
        for old in (edges, low, large, lower):
            removed(old)
        edges = after
        before, state = state, _told(edges)
    tops = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(tops)
