"""The star-schema tables as a graph: nodes, edges, passages, lexicon and statement feeds.

Each class and relation is one projection with a literal name, so a filter on
type or rel removes the other branches of the union before anything is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes and what they are kinds of; relations with domain and range.
CLASSES = {"Region": "Place", "Nation": "Place", "Customer": "Party", "Supplier": "Party", "Part": None, "Order": None, "Document": None, "Place": None, "Party": None}
RELATIONS = {
    "in_region": ("Nation", "Region"),
    "in_nation": ("Party", "Nation"),
    "placed_by": ("Order", "Customer"),
    "contains": ("Order", "Part"),
    "supplied_by": ("Order", "Supplier"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "."), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label, status, as_of, valid_from, valid_to, source_doc, superseded_by, summary, attributes, tags, sources."""
    none = F.lit(None).cast("string")

    def kind(name, key, label, *attributes, type_, status=F.lit("current"), as_of=none, source=none, tags=None):
        t = table(spark, sf_dir, name)
        tags = F.array().cast("array<string>") if tags is None else tags
        return t.select(
            ref(key[0], key[1]).alias("id"),
            F.lit(type_).alias("type"),
            label.cast("string").alias("label"),
            status.alias("status"),
            as_of.alias("as_of"),
            as_of.alias("valid_from"),
            none.alias("valid_to"),
            source.alias("source_doc"),
            none.alias("superseded_by"),
            none.alias("summary"),
            F.to_json(F.struct(*attributes)).alias("attributes"),
            tags.alias("tags"),
            F.when(source.isNull(), F.array().cast("array<string>")).otherwise(F.array(source)).alias("sources"),
        )

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    state = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "P", "intended").otherwise("current")
    parts = [
        kind("region", ("region", "r_regionkey"), F.col("r_name"), F.col("r_name").alias("name"), type_="Region"),
        kind("nation", ("nation", "n_nationkey"), F.col("n_name"), F.col("n_name").alias("name"), type_="Nation"),
        kind("customer", ("customer", "c_custkey"), F.col("c_name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), type_="Customer", tags=F.array(F.lower("c_mktsegment"))),
        kind("supplier", ("supplier", "s_suppkey"), F.col("s_name"), F.col("s_acctbal").alias("balance"), type_="Supplier"),
        kind("part", ("part", "p_partkey"), F.col("p_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), type_="Part"),
        kind("orders", ("order", "o_orderkey"), ref("order", "o_orderkey"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), day.alias("ordered"), type_="Order", status=state, as_of=day),
        kind("documents", ("document", "doc_id"), ref("document", "doc_id"), F.col("n_chars"), F.col("lang"), type_="Document", source=F.col("source"), tags=F.array("lang")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """src, rel, dst, status, derived_by, premises; each triple once, or as often as the tables say it."""

    def rel(name, src, type_, dst):
        t = table(spark, sf_dir, name)
        return t.select(ref(*src).alias("src"), F.lit(type_).alias("rel"), ref(*dst).alias("dst"))

    order = ("order", "l_orderkey")
    parts = [
        rel("nation", ("nation", "n_nationkey"), "in_region", ("region", "n_regionkey")),
        rel("customer", ("customer", "c_custkey"), "in_nation", ("nation", "c_nationkey")),
        rel("supplier", ("supplier", "s_suppkey"), "in_nation", ("nation", "s_nationkey")),
        rel("orders", ("order", "o_orderkey"), "placed_by", ("customer", "o_custkey")),
        rel("lineitem", order, "contains", ("part", "l_partkey")),
        rel("lineitem", order, "supplied_by", ("supplier", "l_suppkey")),
    ]
    parts = [*parts[:4], *(p.distinct() if once else p for p in parts[4:])]
    return reduce(DataFrame.unionByName, parts).select(
        "*", F.lit("current").alias("status"), F.lit(None).cast("string").alias("derived_by"), F.array().cast("array<string>").alias("premises")
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, title, body of the documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of what a user last did: id, chain, valid_from, valid_to, value, status.

    A version holds until the next of its user and type begins.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    nxt, succ = F.lead("ts").over(w), F.lead("event_id").over(w)
    return e.select(
        ref("event", "event_id").alias("id"),
        F.concat_ws(".", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("chain"),
        text("ts").alias("valid_from"),
        text(nxt).alias("valid_to"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(nxt.isNull(), "current").otherwise("superseded").alias("status"),
        F.when(succ.isNotNull(), F.concat(F.lit("event."), succ.cast("string"))).alias("superseded_by"),
    )
