"""Change management: diffs, checks of a candidate, merges of proposals, vetting of sources, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import BLOCK, DETECTORS, privacy_findings
from kgspark.functions.expressions import ISO_DATE, edge_key, fingerprint
from kgspark.functions.text import normalised, number_stated, quoted_in
from kgspark.operators.shapes import mistyped, nonconforming, undeclared
from kgspark.operators.temporal import broken_handover
from kgspark.plans.vocabulary import Vocabulary
from kgspark.schema import STATUSES

FACTUAL = ("type", "label", "status", "attributes", "valid_from", "valid_to", "superseded_by")
PROVENANCE = ("source_doc", "sources", "as_of", "evidence")


def _fields(columns: list[str], group: tuple[str, ...]) -> list[str]:
    return [c for c in group if c in columns]


def canonical(attributes: str | Column = "attributes") -> Column:
    """JSON attributes with keys in order, so that equal ones are equal text."""
    pairs = F.map_entries(F.from_json(attributes, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def node_diff(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, change, fields): added, removed, changed (facts), re-provenanced (only where facts are from)."""

    def hashed(df: DataFrame, side: str) -> DataFrame:
        cols = []
        for c in [*_fields(df.columns, FACTUAL), *_fields(df.columns, PROVENANCE)]:
            cols.append((canonical() if c == "attributes" else F.col(c)).alias(f"{side}_{c}"))
        return df.select(F.col("id").alias(f"{side}_id"), *cols)

    a, b = hashed(live, "a"), hashed(candidate, "b")
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer")
    shared = [c for c in FACTUAL + PROVENANCE if f"a_{c}" in both.columns and f"b_{c}" in both.columns]
    moved = F.filter(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in shared)), lambda x: x.isNotNull())
    out = both.select(F.coalesce("a_id", "b_id").alias("id"), "a_id", "b_id", moved.alias("fields"))
    facts = F.arrays_overlap("fields", F.array(*map(F.lit, FACTUAL)))
    change = F.when(F.col("a_id").isNull(), "added").when(F.col("b_id").isNull(), "removed").when(facts, "changed").when(F.size("fields") > 0, "re-provenanced")
    one_side = F.col("a_id").isNull() | F.col("b_id").isNull()
    fields = F.when(one_side, F.array().cast("array<string>")).otherwise(F.col("fields"))
    return out.select("id", change.alias("change"), fields.alias("fields")).where("change IS NOT NULL")


def introduced(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, text): what a candidate adds in words, for a privacy scan: new or changed labels, summaries and attributes.

    Attributes follow as ``name: value``, by name.  Nodes that add nothing have no row.
    """
    held = F.from_json("attributes", "map<string,string>")
    old = live.select(F.col("id").alias("_o"), F.col("label").alias("_l"), F.col("summary").alias("_s"), held.alias("_a"))
    new = candidate.select("id", "label", "summary", held.alias("a"))
    rows = new.join(old, new["id"] == old["_o"], "left")
    prose = [F.when((F.col(c) != "") & ~F.col(c).eqNullSafe(F.col(o)), F.col(c)) for c, o in (("label", "_l"), ("summary", "_s"))]
    said = lambda e: F.when(~e["value"].eqNullSafe(F.try_element_at("_a", e["key"])), F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    facts = F.coalesce(F.transform(F.array_sort(F.map_entries("a")), said), F.array().cast("array<string>"))
    parts = F.filter(F.concat(F.array(*prose), facts), lambda x: x.isNotNull())
    return rows.select("id", parts.alias("p")).where(F.size("p") > 0).select("id", F.array_join("p", "\n").alias("text"))


def edge_diff(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """(src, rel, dst, change): added or removed triples."""
    key = ["src", "rel", "dst"]
    a, b = live.select(*key).distinct(), candidate.select(*key).distinct()
    gone = a.join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(gone)


def graph_fingerprint(nodes: DataFrame) -> DataFrame:
    """(id, sha) of every node."""
    cols = [c for c in nodes.columns if c != "id"]
    return nodes.select("id", fingerprint("id", *cols).alias("sha"))


def _found(rows: DataFrame, severity: str, subject, detail) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(severity).alias("severity"), subject.alias("subject"), detail.alias("detail"))


def check(live: DataFrame, nodes: DataFrame, edges: DataFrame, vocabulary: Vocabulary | None = None, assertions: DataFrame | None = None) -> DataFrame:
    """(severity, subject, detail) of a candidate against the live nodes: blocking, contradiction or gap."""
    nid = F.col("id")
    out = [
        _found(nodes.where("id IS NULL OR id = ''"), "blocking", F.lit("(no id)"), "a node has no id"),
        _found(nodes.where("id IS NOT NULL").groupBy("id").count().where("count > 1"), "blocking", nid, "duplicate node id"),
        _found(nodes.where(~F.coalesce("status", F.lit("current")).isin(*STATUSES)), "blocking", nid, "invalid status"),
    ]
    for c in ("as_of", "valid_from", "valid_to"):
        out.append(_found(nodes.where(F.col(c).isNotNull() & (F.col(c) != "") & ~F.col(c).rlike(ISO_DATE)), "blocking", nid, f"{c} is not a date"))
    known = nodes.select("id").union(live.select("id")).distinct().select(F.col("id").alias("_k"))
    targets = nodes.select("id", F.col("superseded_by").alias("to")).where("to IS NOT NULL")
    if "supersedes" in nodes.columns:
        targets = targets.union(nodes.select("id", F.explode("supersedes")))
    out.append(_found(targets.join(known, targets["to"] == known["_k"], "left_anti"), "blocking", nid, "supersession points at an unknown id"))
    out.append(_found(dangling(nodes, edges), "blocking", F.col("edge"), "an end is unknown"))
    if vocabulary is not None:
        kinds = [*vocabulary.classes, *vocabulary.former_names()]
        out.append(_found(nodes.where(~F.col("type").isin(*kinds)), "blocking", nid, "type is not declared"))
        out.append(_found(edges.where(~F.col("rel").isin(*vocabulary.properties)), "blocking", edge_key(), "relation is not declared"))
        out.append(_found(mistyped(vocabulary, nodes), "blocking", F.col("node_id"), "an attribute has not its type"))
        out.append(_found(undeclared(vocabulary, nodes), "gap", F.concat_ws(".", "class", "name"), "attribute is not declared"))
        out.append(_found(nonconforming(vocabulary, nodes, edges), "gap", F.col("rel"), F.concat_ws(" ", "side", F.lit("is"), "actual")))
    if assertions is not None:
        cited = nodes.select("id", F.explode("sources").alias("s")).where(F.col("s").startswith("assertion:"))
        on_record = assertions.select(F.concat(F.lit("assertion:"), F.col("id")).alias("_s"))
        out.append(_found(cited.join(on_record, cited["s"] == on_record["_s"], "left_anti"), "blocking", nid, "cites an assertion that is not on record"))
        out.append(_found(assertions.groupBy("id").count().where("count > 1"), "blocking", F.concat(F.lit("assertion:"), nid), "names more than one assertion"))
    out.append(_found(contradictions(live, nodes), "contradiction", nid, "changed without a supersession record"))
    if "supersedes" in nodes.columns:
        succ = nodes.unionByName(live.join(nodes, "id", "left_anti"), allowMissingColumns=True)
        succ = succ.select(F.col("id").alias("_sid"), F.col("supersedes").alias("_back"), F.col("status").alias("_sstatus"))
        ahead = nodes.join(succ, nodes["superseded_by"] == succ["_sid"])
        out.append(_found(ahead.where(~F.coalesce(F.array_contains("_back", nid), F.lit(False))), "blocking", nid, "the chain does not point both ways"))
        out.append(_found(ahead.where("status != 'superseded'"), "blocking", nid, "has a successor but is not superseded"))
        behind = nodes.select("id", F.explode("supersedes").alias("_old")).join(succ, F.col("_old") == F.col("_sid"))
        out.append(_found(behind.where("_sstatus != 'superseded'"), "blocking", nid, "supersedes a node that is not retired"))
    out.append(_found(broken_handover(nodes), "gap", nid, "dates do not hand over"))
    new = nodes.join(live.select("id"), "id", "left_anti")
    for c in ("as_of", "valid_from", "source_doc"):
        out.append(_found(new.where(F.coalesce(c, F.lit("")) == ""), "gap", nid, f"no {c}"))
    out.append(_found(new.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0), "gap", nid, "cites no source"))
    if "evidence" in nodes.columns:
        out.append(_found(new.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "gap", nid, "no evidence"))
    return reduce(DataFrame.union, out)


def contradictions(live: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, fields): facts that differ from the live ones with no supersession on record on either side."""
    changed = node_diff(live, candidate).where("change = 'changed'")
    fields = F.array_except("fields", F.array(F.lit("status"), F.lit("valid_to"), F.lit("superseded_by")))
    supersedes = F.coalesce(F.size("supersedes") > 0, F.lit(False)) if "supersedes" in candidate.columns else F.lit(False)
    new = candidate.select(F.col("id").alias("_id"), F.col("status").alias("_new"), (F.col("superseded_by").isNotNull() | supersedes).alias("_marked"))
    old = live.select(F.col("id").alias("_oid"), F.col("status").alias("_old"))
    rows = changed.join(new, changed["id"] == new["_id"]).join(old, changed["id"] == old["_oid"])
    became = (F.col("_old") == "intended") & (F.col("_new") == "current")
    recorded = F.col("_marked") | (F.col("_new") == "superseded") | (F.col("_old") == "superseded") | became
    return rows.where(~F.coalesce(recorded, F.lit(False))).select("id", fields.alias("fields")).where(F.size("fields") > 0)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, end): ends of edges that no node has."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    parts = [edges.join(ids, edges[c] == ids["_id"], "left_anti").select(edge_key().alias("edge"), F.col(c).alias("end")) for c in ("src", "dst")]
    return parts[0].union(parts[1])


def node_names(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, name): labels and aliases in lower case."""
    own = nodes.select("id", F.lower("label").alias("name"))
    if aliases is not None:
        own = own.union(aliases.select(F.col("node_id"), F.lower("alias")))
    return own.where("name != ''").distinct()


def suspects(nodes: DataFrame, proposed: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, other): proposed new nodes that share a name with a node of another id.

    A name that many have links each proposed node to the smallest id with it.
    """
    new = proposed.join(nodes.select("id"), "id", "left_anti")
    have = node_names(nodes, aliases).groupBy("name").agg(F.min("id").alias("other"))
    return node_names(new).join(have, "name").where("id != other").select("id", "other").distinct()


def merge(nodes: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, outcome, fields): added, merged, updated, conflict or problem, for every proposed node.

    A conflict is a known field or attribute with another value; new attributes
    and dates of a known node update it; otherwise it is merged (re-attested).
    """
    old = nodes.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("type", "label", "status", "attributes", "valid_from", "valid_to")))
    rows = proposed.join(old, proposed["id"] == old["_id"], "left")
    mine, theirs = F.from_json("attributes", "map<string,string>"), F.from_json("_attributes", "map<string,string>")
    mine, theirs = F.coalesce(mine, F.create_map().cast("map<string,string>")), F.coalesce(theirs, F.create_map().cast("map<string,string>"))
    clash = F.map_filter(mine, lambda k, v: F.coalesce(F.try_element_at(theirs, k) != v, F.lit(False)))
    fresh = F.map_filter(mine, lambda k, v: ~F.array_contains(F.map_keys(theirs), k))
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    facts = F.array(*(F.when(differs(c), F.lit(c)) for c in ("type", "label", "status")), F.when(F.size(F.map_keys(clash)) > 0, F.lit("attributes")))
    facts = F.filter(facts, lambda x: x.isNotNull())
    dates = F.filter(F.array(*(F.when(differs(c), F.lit(c)) for c in ("valid_from", "valid_to"))), lambda x: x.isNotNull())
    more = F.transform(F.array_sort(F.map_keys(fresh)), lambda k: F.concat(F.lit("attributes."), k))
    lacks = F.filter(F.array(*(F.when(F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in ("type", "label"))), lambda x: x.isNotNull())
    new = F.col("_id").isNull()
    outcome = (
        F.when(new & (F.size(lacks) > 0), "problem").when(new, "added").when(F.size(facts) > 0, "conflict").when(F.size(dates) + F.size(more) > 0, "updated").otherwise("merged")
    )
    fields = F.when(new, lacks).when(F.size(facts) > 0, facts).otherwise(F.concat(dates, more))
    return rows.select("id", outcome.alias("outcome"), fields.alias("fields"))


def merged(nodes: DataFrame, proposed: DataFrame, source_doc: str, as_of: str) -> DataFrame:
    """The nodes after a merge without conflicts: new ones added with defaults, known ones with new attributes, sources and dates."""
    report = merge(nodes, proposed)
    ok = proposed.join(report.where("outcome IN ('added', 'merged', 'updated')").select("id"), "id", "left_semi")
    new = ok.join(nodes.select("id"), "id", "left_anti").withColumns(
        {
            "status": F.coalesce("status", F.lit("current")),
            "as_of": F.coalesce("as_of", F.lit(as_of)),
            "source_doc": F.coalesce("source_doc", F.lit(source_doc)),
            "sources": F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, F.col("sources")).otherwise(F.array(F.lit(source_doc))),
        }
    )
    p = ok.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("attributes", "sources", "as_of", "valid_from", "valid_to")))
    known = nodes.join(p, nodes["id"] == p["_id"], "left")
    # Variants keep what kind of value each is.
    old, new_ = (F.from_json(c, "map<string,variant>") for c in ("attributes", "_attributes"))
    both = F.to_json(F.map_concat(F.map_filter(new_, lambda k, v: ~F.array_contains(F.map_keys(old), k)), old))
    hit = F.col("_id").isNotNull()
    known = known.withColumns(
        {
            "attributes": F.when(F.col("_attributes").isNull(), F.col("attributes")).when(F.col("attributes").isNull(), F.col("_attributes")).otherwise(both),
            "sources": F.when(hit, F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("_sources", F.array(F.lit(source_doc))))).otherwise(F.col("sources")),
            "as_of": F.when(hit, F.greatest("as_of", F.coalesce("_as_of", F.lit(as_of)))).otherwise(F.col("as_of")),
            "valid_from": F.coalesce("_valid_from", "valid_from"),
            "valid_to": F.coalesce("_valid_to", "valid_to"),
        }
    )
    return known.select(*nodes.columns).unionByName(new.select(*nodes.columns))


# Sources.

CURATION = ("curation:", "manual:")


def vet_audit(nodes: DataFrame, vetted: DataFrame) -> DataFrame:
    """(id, verdict, dead): nodes that cite a source which is not vetted; pure if no citation is live, else mixed.

    Curation marks (by prefix) are not dead citations.
    """
    mark = F.col("source").startswith(CURATION[0]) | F.col("source").startswith(CURATION[1])
    rows = nodes.select("id", F.explode("sources").alias("source"))
    ok = vetted.select(F.col("source").alias("_ok")).distinct()
    rows = rows.join(ok, rows["source"] == ok["_ok"], "left").withColumn("dead", F.col("_ok").isNull() & ~mark)
    by = rows.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("dead"), F.col("source")))).alias("dead"))
    return by.where(F.size("dead") > 0).select("id", F.when(F.size("dead") == F.col("n"), "pure").otherwise("mixed").alias("verdict"), "dead")


def vet_plan(nodes: DataFrame, edges: DataFrame, vetted: DataFrame, remove: DataFrame | None = None, fallback: str | None = None) -> DataFrame:
    """(id, action, sources): stripped, removed, resourced, fallback or orphaned."""
    audit = vet_audit(nodes, vetted)
    pure = audit.where("verdict = 'pure'").select("id")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).join(pure, "id", "left_semi").distinct()
    live = nodes.select(F.col("id").alias("other"), F.explode("sources").alias("source")).join(vetted.select("source").distinct(), "source", "left_semi")
    attested = both.join(live, "other").groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = audit.join(attested, "id", "left")
    asked = F.lit(False)
    if remove is not None:
        out = out.join(remove.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
        asked = F.coalesce("_asked", F.lit(False))
    action = (
        F.when(F.col("verdict") == "mixed", "stripped").when(asked, "removed").when(F.col("sources").isNotNull(), "resourced").otherwise("fallback" if fallback else "orphaned")
    )
    sources = F.when(action == "resourced", F.col("sources"))
    if fallback:
        sources = F.when(action == "fallback", F.array(F.lit(fallback))).otherwise(sources)
    return out.select("id", action.alias("action"), sources.alias("sources"))


def vet_rewrite(nodes: DataFrame, plan: DataFrame, vetted: DataFrame, as_of: str) -> DataFrame:
    """Nodes after a plan: removed ones gone, dead citations stripped, re-sourced ones marked as inferred; orphans stay as they are."""
    p = plan.select(F.col("id").alias("_id"), "action", F.col("sources").alias("_new"))
    cites = nodes.select(F.col("id").alias("_cid"), F.posexplode("sources").alias("_pos", "_s"))
    ok = vetted.select(F.col("source").alias("_ok")).distinct()
    cites = cites.join(ok, cites["_s"] == ok["_ok"], "left").where(F.col("_ok").isNotNull() | F.col("_s").startswith(CURATION[0]) | F.col("_s").startswith(CURATION[1]))
    kept = cites.groupBy("_cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_s"))), lambda x: x["_s"]).alias("_kept"))
    rows = nodes.join(p, nodes["id"] == p["_id"], "left").join(kept, nodes["id"] == kept["_cid"], "left")
    rows = rows.where(F.coalesce("action", F.lit("")) != "removed")
    inferred = F.col("action").isin("resourced", "fallback")
    touched = inferred | (F.col("action") == "stripped")
    sources = F.when(inferred, F.col("_new")).when(F.col("action") == "stripped", F.col("_kept")).otherwise(F.col("sources"))
    doc = F.when(touched & ~F.coalesce(F.array_contains(sources, F.col("source_doc")), F.lit(False)), F.try_element_at(sources, F.lit(1))).otherwise(F.col("source_doc"))
    return rows.select(
        *(c for c in nodes.columns if c not in ("sources", "source_doc", "as_of")),
        sources.alias("sources"), doc.alias("source_doc"),
        F.when(F.coalesce(touched, F.lit(False)), F.lit(as_of)).otherwise(F.col("as_of")).alias("as_of"),
        F.when(F.coalesce(inferred, F.lit(False)), "inferred").alias("provenance"),
    )


def reattest(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, source, since): nodes that cite a document of which there is a version newer than their as_of.

    versions: source, since.
    """
    newest = versions.groupBy("source").agg(F.max("since").alias("since"))
    rows = nodes.select("id", "as_of", F.explode("sources").alias("source")).join(newest, "source")
    return rows.where("as_of < since").select("id", "source", "since")


# Evidence.


def evidence_held(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quotes (id, doc, quote) with ``held``: whether the document has the quote, part by part between ellipses.

    docs: doc, text.  A quote of a document that is not there is not held.
    """
    texts = docs.select(F.col("doc").alias("_doc"), normalised("text").alias("_text"))
    rows = quotes.withColumn("_quote", normalised("quote")).join(texts, quotes["doc"] == texts["_doc"], "left")
    return rows.select(*quotes.columns, quoted_in(F.col("_quote"), F.col("_text")).alias("held"))


def numbers_stated(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """claims (id, doc, value) with ``stated``: whether a number in the document is the value."""
    rows = claims.join(docs.select(F.col("doc").alias("_doc"), F.col("text").alias("_text")), F.col("doc") == F.col("_doc"), "left")
    return rows.select(*claims.columns, number_stated(F.col("value"), F.col("_text")).alias("stated"))


def ledger_summary(before: DataFrame, after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """One row for a ledger: nodes added, changed and removed, edges added, ids retired by status."""
    d = node_diff(before, after)
    retired = after.where("status = 'superseded'").select("id").join(before.where("status != 'superseded'").select("id"), "id", "left_semi")
    n = d.agg(*(F.count_if(F.col("change") == c).alias(f"nodes_{c}") for c in ("added", "changed", "removed")))
    e = edge_diff(edges_before, edges_after).agg(F.count_if(F.col("change") == "added").alias("edges_added"))
    r = retired.agg(F.count("*").alias("retired"))
    one = F.lit(1).alias("_one")
    return n.select("*", one).join(e.select("*", one), "_one").join(r.select("*", one), "_one").drop("_one")


# Definitions, sources and gates.


def repeated_ids(log: DataFrame) -> DataFrame:
    """(id, n): ids that more than one entry of a log has; entries without an id, or with one that was not readable, do not count."""
    rows = log.where((F.col("id") != "") & (F.col("id") != "(unparseable)"))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def changelog(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries of a ledger, flat: at, by, note, nodes_added, nodes_changed, edges_added, retired, sources (JSON lists).

    ledger: at, by, note, nodes (added, changed), edges (added), retired and sources (arrays).
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    listed = lambda c: F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>")))
    rows = ledger.select(
        "at", "by", "note", n("nodes.added").alias("nodes_added"), n("nodes.changed").alias("nodes_changed"), n("edges.added").alias("edges_added"),
        listed("retired").alias("retired"), listed("sources").alias("sources"),
    )
    return rows.orderBy(F.desc("at"), *(c for c in rows.columns if c != "at")).limit(limit)


def definition_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(id, change): added, removed, changed or reworded definitions (id, definition: a JSON object).

    A definition is changed if one of the ``keys`` that decide what it answers
    differs, whatever the order of members and white space; otherwise it is reworded.
    """
    plain = lambda c: F.col(c).try_cast("string")
    part = lambda c, k: F.to_json(F.try_variant_get(F.try_parse_json(plain(c)), f"$.{k}", "variant"))
    both = old.select("id", F.col("definition").alias("_old")).join(new.select("id", F.col("definition").alias("_new")), "id", "full")
    whole = lambda c: F.to_json(F.try_parse_json(plain(c)))
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~part("_old", k).eqNullSafe(part("_new", k))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(changed, "changed").when(~whole("_old").eqNullSafe(whole("_new")), "reworded")
    )
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def impact(changes: list[tuple[str, str]], nodes: DataFrame, edges: DataFrame, vocabulary) -> DataFrame:
    """(kind, subject, affected): how many nodes or edges each breaking change of the vocabulary touches.

    ``vocabulary`` is the one that the changes lead to, and gives what a class or
    relation covers.  A concept counts where the attribute's declared type is its
    scheme; values removed from an attribute are those that it has no longer.
    Changes are configuration: each becomes rows of what it counts, and counts by
    type, relation, carried attribute and value are one aggregation each.
    """
    spark = nodes.sparkSession
    rows = []
    typed = {(kind, name): spec.get("type", "string") for kind in vocabulary.classes for name, spec in vocabulary.attributes(kind).items()}
    for kind, subject in changes:
        head, _, tail = subject.partition(".")
        if kind == "class removed":
            rows.append((kind, subject, "type", subject, None, None))
        elif kind == "superclass removed":
            rows += [(kind, subject, "type", c, None, None) for c in vocabulary.covers(subject)]
        elif kind in ("relation removed", "domain changed", "range changed"):
            rows.append((kind, subject, "rel", subject, None, None))
        elif kind == "superproperty removed":
            rows += [(kind, subject, "rel", r, None, None) for r in vocabulary.relations_of(subject)]
        elif kind in ("attribute removed", "attribute type changed"):
            rows.append((kind, subject, "attribute", subject, None, None))
        elif kind in ("concept removed", "scheme removed"):
            of = [f"{k}.{a}" for (k, a), t in typed.items() if t == f"scheme:{head}"]
            rows += [(kind, subject, "value", name, [tail] if tail else None, None) for name in of]
        elif kind == "attribute values removed":
            rows.append((kind, subject, "value", subject, None, sorted(vocabulary.values_of(head, tail))))
        else:
            raise ValueError(f"no counts for {kind}")
    asked = sorted({r[3] for r in rows if r[2] == "value"})
    table = spark.createDataFrame(rows, "kind string, subject string, what string, name string, only array<string>, but array<string>")
    keys = F.explode(F.json_object_keys(F.coalesce("attributes", F.lit("{}"))))
    name = F.concat_ws(".", "type", "key").alias("name")
    carried = nodes.select("type", keys.alias("key"))
    # Only classes and attributes whose values are asked for are taken apart.
    value = nodes.where(F.col("type").isin(sorted({n.split(".")[0] for n in asked}) or [""])).select("type", F.explode(F.from_json("attributes", "map<string,string>")))
    value = value.select(name, "value").where(F.col("name").isin(asked or [""]) & (F.col("value") != ""))
    none = F.lit(None).cast("string").alias("value")
    counts = [
        nodes.groupBy(F.lit("type").alias("what"), F.col("type").alias("name"), none).agg(F.count("*").alias("n")),
        edges.groupBy(F.lit("rel").alias("what"), F.col("rel").alias("name"), none).agg(F.count("*").alias("n")),
        carried.groupBy(F.lit("attribute").alias("what"), name, none).agg(F.count("*").alias("n")),
        value.groupBy(F.lit("value").alias("what"), "name", "value").agg(F.count("*").alias("n")),
    ]
    # Distinct values may be many; the changes, declared by hand, are few.
    found = reduce(DataFrame.union, counts).join(F.broadcast(table), ["what", "name"])
    found = found.where("(only IS NULL OR array_contains(only, value)) AND (but IS NULL OR NOT array_contains(but, value))")
    found = found.groupBy("kind", "subject").agg(F.sum("n").alias("n"))
    every = spark.createDataFrame(sorted(set(changes)), "kind string, subject string")
    return every.join(found, ["kind", "subject"], "left").select("kind", "subject", F.coalesce("n", F.lit(0)).alias("affected"))


SOURCE_TYPES = ("document", "human_assertion", "inference")


def source_types(nodes: DataFrame) -> DataFrame:
    """(source_type, n): how facts are sourced; none said means a document, an unknown one counts as unrecorded."""
    kind = F.coalesce("source_type", F.lit("document"))
    kind = F.when(kind.isin(*SOURCE_TYPES), kind).otherwise("unrecorded")
    return nodes.groupBy(kind.alias("source_type")).agg(F.count("*").alias("n"))


def privacy_gate(docs: DataFrame, key: str = "doc_id", text: str = "text", detectors=DETECTORS) -> DataFrame:
    """(key, station, kinds): quarantine with a blocking finding, review with another one, else accepted."""
    found = privacy_findings(docs.select(key, text), key, text, detectors)
    found = found.groupBy(key).agg(F.max(F.col("severity") == BLOCK).alias("blocks"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    out = docs.select(key).join(found, key, "left")
    station = F.when(F.col("blocks"), "quarantine").when(F.col("kinds").isNotNull(), "review").otherwise("accepted")
    return out.select(key, station.alias("station"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
