"""Decision records and figures in Markdown documents.

A decision record begins with fenced fields (``key: value``, ``key: [a, b]`` or a
list of dashes) and has sections, one of them called Decision.  Everything that
one document says is taken apart within its row; names are looked up by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.sources.shared import checkpointed

# The fields of a record, the lists among them with the relation that each becomes, and what a status may be.
FIELDS = ["id", "title", "status", "decided_on", "decided_by", "governs", "resolves", "about", "supersedes"]
LISTS = ["governs", "resolves", "about"]
DECISION_STATUSES = ["proposed", "accepted"]
RECORD_ID = r"(?i)^ADR-[0-9]{1,6}$"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
FENCE = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n"
HEADING = r"#{1,3}[ \t]+\S"

# How a figure stands in an extracted text, before and after it is described, and the heading of its page.
FIGURE = r"^> \*\*\[DIAGRAM\]\*\* \((.+?)\) — see `assets/([^/]+)/((?:slide|page|image)-(\d+)\.(?:png|jpe?g|gif|webp|svg))`\."
PENDING = r" _Description added in review pass\._\s*$"
PAGE = r"^#{2,4} (?:Slide|Page) \d+(?: — (.*))?$"
NO_LABELS = "A visual graphic; see the linked image for the full layout."
SUMMARY = "**Description (auto-summary from on-slide text):** "
MOST_LABELS, MOST_CHARACTERS, LINES_AFTER = 8, 120, 29


# Decision records.


def _bare(c: Column) -> Column:
    """Without blanks around it, then without one pair of quotes."""
    t = F.trim(c)
    quoted = t.rlike(r"""(?s)^(".*"|'.*')$""") & (F.length(t) > 1)
    return F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def fields(text: Column) -> Column:
    """The fenced fields as array<struct<key, value, items, nested>>; items only of lists, nested for what is no list and no value."""
    block = F.regexp_extract(text, FENCE, 1)
    lines = F.filter(F.split(block, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    parts = F.split(F.array_join(lines, "\n"), r"(?m)^(?=[^ \t:\n][^:\n]*:)")
    parts = F.filter(parts, lambda x: x.rlike(r"^[^ \t:\n][^:\n]*:"))
    # Step by step, since what a step has is worked out once, but an expression as often as it is named.
    parts = F.transform(parts, lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^([^:\n]*):", 1)).alias("key"),
        F.trim(F.regexp_extract(x, r"^[^:\n]*:([^\n]*)", 1)).alias("said"),
        F.filter(F.regexp_extract_all(x, F.lit(r"\n[ \t]+([^\n]*)"), F.lit(1)), lambda y: y != "").alias("below"),
    ))
    parts = F.transform(parts, lambda x: F.struct(
        x["key"].alias("key"), x["said"].alias("said"), x["below"].alias("below"),
        F.filter(x["below"], lambda y: F.ltrim(y).startswith("- ")).alias("dashes"), x["said"].rlike(r"^\[.*\]$").alias("in_brackets"),
    ))

    def one(x: Column) -> Column:
        said, below, dashes, in_brackets = (x[k] for k in ("said", "below", "dashes", "in_brackets"))
        first = F.filter(F.split(F.substr(said, F.lit(2), F.length(said) - 2), ","), lambda y: F.trim(y) != "")
        listed = in_brackets | (said == "")
        first = F.when(in_brackets, first).otherwise(F.array().cast("array<string>"))
        items = F.transform(F.concat(first, F.transform(dashes, lambda y: F.substr(F.ltrim(y), F.lit(3)))), _bare)
        nested = (F.size(below) > F.size(dashes)) | (~listed & (F.size(below) > 0))
        return F.struct(
            x["key"].alias("key"),
            F.when(~listed & ~nested, _bare(said)).alias("value"),
            F.when(listed & ~nested, items).alias("items"),
            nested.alias("nested"),
        )

    return F.coalesce(F.transform(parts, one), F.array().cast("array<struct<key:string,value:string,items:array<string>,nested:boolean>>"))


def sections(text: Column) -> Column:
    """array<struct<heading, body>>: what stands under each heading of up to three marks, its lines joined by blanks."""
    rest = F.regexp_replace(text, FENCE, "")
    parts = F.filter(F.split(rest, rf"(?m)^(?={HEADING})"), lambda x: x.rlike(f"^{HEADING}"))

    def one(lines: Column) -> Column:
        body = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x != "")
        return F.struct(F.regexp_replace(F.get(lines, F.lit(0)), r"^#+[ \t]+", "").alias("heading"), F.array_join(body, " ").alias("body"))

    parts = F.transform(parts, lambda x: F.transform(F.split(x, "\n"), lambda y: F.trim(y)))
    return F.coalesce(F.transform(parts, one), F.array().cast("array<struct<heading:string,body:string>>"))


def _last(items: Column, name: str, key: str = "key") -> Column:
    """Of entries of one name the last counts."""
    return F.try_element_at(F.filter(items, lambda x: x[key] == name), F.lit(-1))


def records(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, is_record, title, decision, quote, id, status, decided_on, decided_by, supersedes, governs, resolves, about, problems).

    problems: what keeps a document from becoming a decision, empty if nothing
    does.  A null or empty text has no fields, which is its one problem.
    """
    rows = docs.select(F.col(doc).alias("doc"), fields(F.coalesce(F.col(text), F.lit(""))).alias("f"), sections(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    rows = rows.select("doc", "f", "s", *(_last(F.col("f"), k).alias(f"_{k}") for k in FIELDS), _last(F.col("s"), "Decision", "heading").alias("_ruling"))
    value = {k: F.col(f"_{k}.value") for k in FIELDS}
    items = {k: F.col(f"_{k}.items") for k in LISTS}
    given = lambda k: F.exists("f", lambda x: x["key"] == k)
    decision = F.nullif(F.col("_ruling.body"), F.lit(""))
    title = F.coalesce(value["title"], F.get("s", F.lit(0))["heading"])
    matches = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    said = lambda cond, what: F.when(cond, F.array(what)).otherwise(F.array().cast("array<string>"))
    strange = F.filter("f", lambda x: ~x["key"].isin(FIELDS))
    wrong = [
        F.transform(strange, lambda x: F.concat(F.lit("field not known: "), x["key"])),
        F.transform(F.filter("f", lambda x: x["nested"] & x["key"].isin(FIELDS)), lambda x: F.concat(F.lit("neither a value nor a list: "), x["key"])),
        said(~matches(value["id"], RECORD_ID), F.lit("id is not ADR and a number")),
        said(~F.coalesce(value["status"].isin(DECISION_STATUSES), F.lit(False)), F.lit(f"status is not one of {', '.join(DECISION_STATUSES)}")),
        said(~matches(value["decided_on"], DAY), F.lit("decided_on is not a day")),
        *(said(given(k) & items[k].isNull(), F.lit(f"not a list: {k}")) for k in LISTS),
        said(given("supersedes") & ~matches(value["supersedes"], RECORD_ID), F.lit("supersedes is not ADR and a number")),
        said(decision.isNull(), F.lit("no section Decision")),
        said(title.isNull(), F.lit("no title")),
    ]
    problems = F.when(F.size("f") == 0, F.array(F.lit("no fields"))).otherwise(F.array_distinct(F.concat(*wrong)))
    first = F.regexp_extract(decision, r"(?s)^(.+?[.!?])(?:\s|$)", 1)
    return rows.select(
        "doc", (matches(value["id"], RECORD_ID) & decision.isNotNull()).alias("is_record"), title.alias("title"), decision.alias("decision"),
        F.when(first != "", first).otherwise(decision).alias("quote"), *(value[k].alias(k) for k in ("id", "status", "decided_on", "decided_by", "supersedes")),
        *(F.coalesce(items[k], F.array().cast("array<string>")).alias(k) for k in LISTS), problems.alias("problems"),
    )


def proposal(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, unresolved) that the records without problems propose to a graph.

    nodes: id, type, label, summary, status, attributes, valid_from, valid_to,
    superseded_by, supersedes, change_note, source_doc: the decision, its document,
    and the decision that it reverses, retired on its day.  edges: src, rel, dst,
    source_doc.  unresolved: source_doc, rel, term: what names nothing in the graph,
    and is not linked.  A term is an id, or a label or alias (aliases: array) as
    written, or in lower case; of several nodes with one name the least id counts.
    Records that share an id give their decisions both, for the merge to refuse.
    Records are written first: a filter on their problems would else be carried
    below what takes the documents apart, and that done for each mention anew.
    """
    good = checkpointed(records.select("doc", "title", "decision", "quote", "id", "status", "decided_on", "decided_by", "supersedes", *LISTS, "problems"))
    good = good.where(F.size("problems") == 0).withColumns({"nid": F.concat(F.lit("decision."), F.lower("id")), "paper": F.concat(F.lit("document."), F.col("doc").cast("string"))})
    rels = F.array(*(F.struct(F.lit(k).alias("rel"), F.col(k).alias("terms")) for k in LISTS), F.struct(F.lit("decided_by").alias("rel"), F.when(F.col("decided_by") != "", F.array("decided_by")).otherwise(F.array().cast("array<string>")).alias("terms")))
    asked = good.select("nid", F.col("doc").alias("source_doc"), F.explode(rels).alias("x")).select("nid", "source_doc", "x.rel", F.explode("x.terms").alias("term"))
    olds = good.where("supersedes IS NOT NULL").select("nid", F.col("doc").alias("source_doc"), F.concat(F.lit("decision."), F.lower("supersedes")).alias("term"))

    names = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in nodes.columns else F.array("label")
    ids = nodes.select(F.col("id").alias("name"), F.lit(0).alias("grade"), "id")
    known = ids.union(nodes.select(F.explode(names), F.lit(1), "id")).where("name <> ''")
    wanted = asked.select("term").union(olds.select("term")).distinct()
    tried = wanted.select("term", F.posexplode(F.array("term", F.lower("term"))).alias("way", "name"))
    known = known.groupBy("name").agg(F.min(F.struct("grade", "id")).alias("hit"))
    # As written by id or name; else in lower case by name only.
    found = tried.join(known, "name").where("way = 0 OR hit.grade = 1").groupBy("term").agg(F.min(F.struct("way", "hit.grade", "hit.id")).alias("hit"))
    found = checkpointed(found)
    linked = asked.join(found, "term", "left").select("nid", "source_doc", "rel", "term", F.col("hit.id").alias("dst"))
    retired = olds.join(found.where("hit.way = 0 AND hit.grade = 0").select("term"), "term", "left_semi")
    missing = olds.join(retired, ["nid", "source_doc", "term"], "left_anti").select("source_doc", F.lit("supersedes").alias("rel"), "term")

    note = F.concat(F.col("id"), F.lit(" supersedes "), F.col("supersedes"), F.lit(" on "), F.col("decided_on"), F.lit(": "), F.col("quote"))
    none = F.lit(None).cast("string")
    good = good.join(retired.select("nid", F.col("source_doc").alias("doc"), F.col("term").alias("old")), ["nid", "doc"], "left")
    row = lambda **c: [c.get(k, none).alias(k) for k in ("id", "type", "label", "summary", "status", "attributes", "valid_from", "valid_to", "superseded_by", "supersedes", "change_note")]
    source, day = F.col("doc").alias("source_doc"), F.col("decided_on")
    said = F.to_json(F.struct("status", "decided_on", F.col("decision").alias("rationale")))
    changed = F.when(F.col("old").isNotNull(), note)
    out = [
        good.select(*row(id=F.col("nid"), type=F.lit("Decision"), label=F.col("title"), summary=F.col("quote"), status=F.lit("current"), attributes=said, valid_from=day, supersedes=F.col("old"), change_note=changed), source),
        good.select(*row(id=F.col("paper"), type=F.lit("Document"), label=F.col("title"), summary=F.concat(F.col("id"), F.lit(", the record of this decision.")), status=F.lit("current"), attributes=F.lit('{"kind":"adr"}'), valid_from=day), source),
        good.where("old IS NOT NULL").select(*row(id=F.col("old"), status=F.lit("superseded"), valid_to=day, superseded_by=F.col("nid"), change_note=note), source),
    ]
    edges = linked.where("dst IS NOT NULL").select(F.col("nid").alias("src"), "rel", "dst", "source_doc")
    edges = edges.union(good.select("nid", F.lit("documented_in"), "paper", source)).distinct()
    return reduce(DataFrame.unionByName, out), edges, linked.where("dst IS NULL").select("source_doc", "rel", "term").union(missing).distinct()


# Figures.


def _lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Lines of the documents with figures, each with the title of its page (filled forward) and whether it is a figure."""
    rows = docs.where(F.contains(F.col(text), F.lit("**[DIAGRAM]**"))).select(F.col(doc).alias("doc"), F.monotonically_increasing_id().alias("_row"), text)
    rows = rows.select("doc", "_row", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    w = Window.partitionBy("doc", "_row").orderBy("no")
    title = F.when(F.col("line").rlike(PAGE), F.regexp_extract("line", PAGE, 1))
    after = F.collect_list("line").over(w.rowsBetween(1, LINES_AFTER))
    rows = rows.withColumn("title", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit("")))
    rows = rows.withColumn("after", after)
    return rows.withColumns({"pending": F.col("line").rlike(FIGURE + PENDING), "summed": F.col("line").rlike(FIGURE + r"\s*$")})


def _summary() -> Column:
    """A figure's description from the bullets of the lines after it."""
    labels = F.filter(F.transform("after", lambda x: F.trim(x)), lambda x: x.startswith("- "))
    labels = F.filter(F.transform(labels, lambda x: F.trim(F.substr(x, F.lit(3)))), lambda x: (x != "") & (F.length(x) < MOST_CHARACTERS))
    named = F.when(F.trim("title") != "", F.concat(F.lit("Diagram titled “"), F.trim("title"), F.lit("”. "))).otherwise("")
    shown = F.concat(F.lit("Key on-slide elements: "), F.array_join(F.slice(labels, 1, MOST_LABELS), "; "), F.lit("."))
    return F.concat(F.lit(SUMMARY), named, F.when(F.size(labels) > 0, shown).otherwise(NO_LABELS))


def _key() -> Column:
    number = F.regexp_replace(F.regexp_extract("line", FIGURE, 4), "^0+(?=.)", "")
    return F.concat(F.regexp_extract("line", FIGURE, 2), F.lit("#"), number)


def figures(docs: DataFrame, doc: str = "doc_id", text: str = "text", curated: DataFrame | None = None) -> DataFrame:
    """(doc, no, key, image, title, reasons, curated, labelled): every figure without a description of its own.

    no is its line, from 0; labelled says that a summary of what is printed on it
    would add something.  A summary that was put in and found no labels is none.
    curated: (key, description).
    """
    rows = _lines(docs, doc, text)
    poor = F.col("summed") & F.coalesce(F.get("after", F.lit(1)).startswith("> **Description (auto-summary") & F.contains(F.get("after", F.lit(1)), F.lit(NO_LABELS)), F.lit(False))
    part = lambda g: F.regexp_extract("line", FIGURE, g)
    labelled = F.col("pending") & F.contains(_summary(), F.lit("Key on-slide elements"))
    found = rows.where(F.col("pending") | poor).select("doc", "no", _key().alias("key"), F.concat(F.lit("assets/"), part(2), F.lit("/"), part(3)).alias("image"), "title", part(1).alias("reasons"), labelled.alias("labelled"))
    if curated is None:
        return found.withColumn("curated", F.lit(False))
    known = curated.select("key").distinct().withColumn("curated", F.lit(True))
    return found.join(known, "key", "left").withColumn("curated", F.coalesce("curated", F.lit(False)))


def described(docs: DataFrame, curated: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, n_curated, n_auto): the documents with figures, each figure that waits for a description given one.

    curated: (key, description), a key once; others get the summary of their labels.
    """
    rows = _lines(docs, doc, text).withColumn("key", F.when(F.col("pending"), _key()))
    rows = rows.join(curated.select("key", "description"), "key", "left")
    body = F.when(F.col("description").isNotNull(), F.concat(F.lit("**Description:** "), F.col("description"))).otherwise(_summary())
    put = F.concat(F.regexp_extract("line", FIGURE, 0), F.lit("\n>\n> "), body)
    rows = rows.withColumn("line", F.when(F.col("pending"), put).otherwise(F.col("line")))
    both = [F.count_if(F.col("pending") & F.col("description").isNotNull()).alias("n_curated"), F.count_if(F.col("pending") & F.col("description").isNull()).alias("n_auto")]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text")
    return rows.groupBy("doc", "_row").agg(whole, *both).drop("_row")
