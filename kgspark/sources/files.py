"""Readers of graph files, passages and logs, and the HTML extractor."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.schema import NODES

_EDGE = "`from` string, rel string, `to` string, status string, derived_by string, premises array<string>"


def graph_file(spark: SparkSession, path: str, was: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON files with the two lists; former class names read as what they became."""
    schema = f"nodes array<struct<{NODES.replace('attributes string', 'attributes variant')}>>, edges array<struct<{_EDGE}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*").withColumn("attributes", F.to_json("attributes"))
    if was:
        nodes = nodes.replace(was, subset=["type"])
    nodes = nodes.withColumn("status", F.coalesce("status", F.lit("current")))
    edges = raw.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), "e.rel", F.col("e.to").alias("dst"), "e.status", "e.derived_by", "e.premises")
    return nodes, edges.withColumn("status", F.coalesce("status", F.lit("current")))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """path, title (the first level-one heading, else the file's name), body of Markdown files below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    heading = F.regexp_extract("body", r"(?m)^# (.*)$", 1)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    return raw.select("path", F.when(heading != "", F.trim(heading)).otherwise(name).alias("title"), "body")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines; comment lines and the ``_meta`` row are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{") & ~F.col("value").rlike(r'^\s*\{\s*"_meta"'))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, column, type, nullable, position) of every table and view of a database."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")):
            rows.append((t.name, c.name, c.dataType, c.nullable, i))
    return spark.createDataFrame(rows, "`table` string, `column` string, type string, nullable boolean, position int")


def native_read(spark: SparkSession, sql: str, limit: int = 100) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows of one SELECT, and whether there are more.

    Spark's parser decides what the text is: anything but a query is refused.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    if any(x in kind for x in ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Set", "Cache", "Load", "Truncate", "Use", "Replace", "Refresh")) or "Statement" in kind:
        raise ValueError(f"only a SELECT is read, not {kind}")
    rows = spark.sql(sql).limit(limit + 1)
    return rows.limit(limit), rows.count() > limit


class _Blocks(HTMLParser):
    """Title, headings, paragraphs and list items; script, style and navigation are skipped."""

    SKIP = {"script", "style", "nav", "noscript", "template", "footer", "header", "aside"}
    KINDS = {"p": "text", "li": "bullet", "td": "cell", "th": "cell", "pre": "text", "blockquote": "text", **{f"h{i}": "heading" for i in range(1, 7)}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.title, self.skip, self.kind, self.level, self.held = "", 0, None, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title" or tag in self.KINDS:
            self.flush()
            self.kind = "title" if tag == "title" else self.KINDS[tag]
            self.level = int(tag[1]) if self.kind == "heading" else 0
        elif tag == "img" and not self.skip:
            alt = dict(attrs).get("alt") or ""
            self.blocks.append(("image", 0, alt.strip()))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title" or tag in self.KINDS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text and self.kind == "title":
            self.title = self.title or text
        elif text:
            self.blocks.append((self.kind or "text", self.level, text))
        self.kind, self.level = None, 0


_ITEM = T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())])
BLOCKS = T.StructType([T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(_ITEM))])


@F.pandas_udf(BLOCKS)
def html_blocks(html: pd.Series) -> pd.DataFrame:
    titles, blocks = [], []
    for text in html.fillna(""):
        parser = _Blocks()
        parser.feed(text)
        parser.close()
        parser.flush()
        titles.append(parser.title)
        blocks.append([{"kind": k, "level": n, "text": t} for k, n, t in parser.blocks])
    return pd.DataFrame({"title": titles, "blocks": blocks})


#: The first title of one line, without the blanks around it.
WRITTEN_TITLE = r"<title>[ \t\n\f\r]*([^\n]*?)[ \t\n\f\r]*</title>"


def documents_of(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title and blocks (kind, level, text) of each page, and the title as it is written, its references not resolved (empty: none)."""
    written = F.coalesce(F.regexp_extract(html, WRITTEN_TITLE, 1), F.lit(""))
    found = pages.withColumns({"_d": html_blocks(html), "title_as_written": written})
    return found.withColumns({"title": F.col("_d.title"), "blocks": F.col("_d.blocks")}).drop("_d")
