"""Vocabularies as triples: written as Turtle, and read from Turtle, from tables and from JSON.

Statements are split and folded into definitions by Spark; what comes to the
driver is a vocabulary, which is configuration.  The Turtle read is the subset
that ``turtle`` writes and most tools can: prefixed names, one statement in one
or more lines, ``;`` and ``,`` between its parts, quoted texts; blank nodes and
collections are refused by ``problems`` of the triples, not misread.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.plans.vocabulary import Vocabulary

# Namespaces of the terms that are written, and the datatypes that stand for types of attributes.
PREFIXES = {
    "kg": "urn:kg:", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}
DATATYPES = {"string": "xsd:string", "number": "xsd:decimal", "integer": "xsd:integer", "boolean": "xsd:boolean", "date": "xsd:date", "list": "rdf:List"}
TYPES = {v: k for k, v in DATATYPES.items()} | {"xsd:double": "number", "xsd:float": "number", "xsd:int": "integer"}

#: A token of Turtle: a quoted text with its language or type, an IRI, a mark, or a name (a dot ends a statement, not a name).
TOKEN = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^[^\s;,]+)?|<[^>]*>|[;,\[\]()]|\.(?=\s|$)|(?:[^\s;,\[\]()"<.]|\.(?!\s|$))+'


def _named(name: str) -> str:
    """A name as a local name: signs other than letters, digits, ``_``, ``-`` and dots within it are written as their bytes."""
    return "kg:" + "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def _said(x) -> str:
    return json.dumps(str(x), ensure_ascii=False)


def _listed(x) -> list[str]:
    return [p.strip() for p in x.split("|") if p.strip()] if isinstance(x, str) else list(x or [])


def statements(v: Vocabulary) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of everything that a vocabulary declares; texts are quoted."""
    out: list[tuple[str, str, str]] = []

    def described(s: str, spec: dict):
        out.extend((s, p, _said(spec[k])) for k, p in (("label", "rdfs:label"), ("definition", "rdfs:comment"), ("note", "skos:note")) if spec.get(k))
        out.extend((s, "skos:altLabel", _said(x)) for x in _listed(spec.get("alt_labels")))

    for name, spec in v.classes.items():
        s = _named(name)
        out.append((s, "a", "owl:Class"))
        out += [(s, "rdfs:subClassOf", _named(x)) for x in _listed(spec.get("subclass_of"))]
        out += [(s, "kg:was", _said(x)) for x in _listed(spec.get("was"))] + [(s, "kg:requires", _said(x)) for x in spec.get("requires") or []]
        described(s, spec)
        for a, of in (spec.get("attributes") or {}).items():
            t, kind = f"{s}.{_named(a)[3:]}", of.get("type", "string")
            out += [(t, "a", "owl:DatatypeProperty"), (t, "rdfs:domain", s)]
            if kind.startswith("scheme:"):
                out.append((t, "kg:scheme", _named(kind[7:])))
            elif kind.startswith("enum:"):
                out += [(t, "kg:value", _said(x)) for x in _listed(kind[5:])]
            elif "type" in of:
                out.append((t, "rdfs:range", DATATYPES[kind]))
            out += [(t, f"kg:{k}", _said(json.dumps(of[k]))) for k in ("required", "pattern", "min_length", "min_value", "max_value") if k in of]
            described(t, of)
    for name, spec in v.properties.items():
        s = _named(name)
        out.append((s, "a", "owl:ObjectProperty"))
        for k, p in (("domain", "rdfs:domain"), ("range", "rdfs:range"), ("subproperty_of", "rdfs:subPropertyOf"), ("inverse", "owl:inverseOf")):
            out += [(s, p, _named(x)) for x in _listed(spec.get(k))]
        out += [(s, f"kg:{k}", _said(json.dumps(spec[k]))) for k in ("min", "max") if spec.get(k) is not None]
        described(s, spec)
    for name, concepts in v.schemes.items():
        s = _named(name)
        out.append((s, "a", "skos:ConceptScheme"))
        for c, spec in concepts.items():
            t = f"{s}.{_named(c)[3:]}"
            out += [(t, "a", "skos:Concept"), (t, "skos:inScheme", s)]
            out += [(t, "skos:broader", f"{s}.{_named(x)[3:]}") for x in _listed((spec or {}).get("broader"))]
            described(t, spec or {})
    return out


def turtle(v: Vocabulary) -> str:
    """The vocabulary as Turtle, a subject in each statement, a part in each line."""
    parts: dict[str, list[str]] = {}
    for s, p, o in statements(v):
        parts.setdefault(s, []).append(f"{p} {o}")
    head = [f"@prefix {k}: <{v}> ." for k, v in PREFIXES.items()]
    return "\n".join([*head, "", *(f"{s} " + " ;\n    ".join(ps) + " ." for s, ps in parts.items())]) + "\n"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, predicate, object) of the statements of files; comments and prefixes are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return triples(files)


def triples(files: DataFrame) -> DataFrame:
    """(file, subject, predicate, object) from (file, text); an object keeps its quotes."""
    text = F.regexp_replace("text", r"(?m)^\s*(?:#.*|@(?:prefix|base)\b.*)$", "")
    rows = files.select("file", F.explode(_groups(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), ".")).alias("t"))
    rows = rows.withColumn("subject", F.get("t", F.lit(0))).select("file", "subject", F.explode(_groups(F.slice("t", F.lit(2), F.size("t")), ";")).alias("t"))
    return rows.select("file", "subject", F.get("t", F.lit(0)).alias("predicate"), F.explode(F.filter(F.slice("t", F.lit(2), F.size("t")), lambda x: x != ",")).alias("object"))


def _groups(tokens: Column, mark: str) -> Column:
    """Runs of tokens between marks, empty ones left out."""
    at = F.filter(F.transform(tokens, lambda x, i: F.when(x == mark, i + 1)), lambda i: i.isNotNull())
    ends = F.concat(at, F.array(F.size(tokens) + 1))
    starts = F.concat(F.array(F.lit(0)), at)
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(tokens, a + 1, F.greatest(b - a - 1, F.lit(0))))
    return F.filter(runs, lambda r: F.size(r) > 0)


def problems(facts: DataFrame) -> DataFrame:
    """(file, subject, problem): statements that are not read, or lack a part."""
    odd = F.exists(F.array("subject", "predicate", "object"), lambda x: x.isin("[", "]", "(", ")"))
    rows = facts.where(odd).select("file", "subject", F.lit("a blank node or a collection").alias("problem"))
    bare = facts.where(~odd & ~F.contains("predicate", F.lit(":")) & (F.col("predicate") != "a")).select("file", "subject", F.concat(F.lit("no prefix: "), "predicate"))
    return rows.union(bare).distinct()


def _plain(x: str) -> str:
    """A name without its prefix, with its signs again; of a text what it says."""
    if x.startswith('"'):
        return json.loads(x[: x.rindex('"') + 1])
    from urllib.parse import unquote

    return unquote(x.split(":", 1)[1])


def vocabulary_of(facts: DataFrame) -> Vocabulary:
    """The vocabulary that triples declare: what they say of a subject is one row, and only those rows are collected."""
    said = facts.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("objects"))
    rows = said.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "objects"))).alias("said")).orderBy("subject").collect()
    v = Vocabulary()
    names = lambda m, p: [_plain(x) for x in m.get(p, [])]

    def described(m: dict) -> dict:
        out = {k: names(m, p)[0] for k, p in (("label", "rdfs:label"), ("definition", "rdfs:comment"), ("note", "skos:note")) if p in m}
        return out | ({"alt_labels": names(m, "skos:altLabel")} if "skos:altLabel" in m else {})

    def some(m: dict, *keys: tuple[str, str]) -> dict:
        return {k: names(m, p) for k, p in keys if p in m}

    for r in rows:
        s, m = r["subject"], r["said"]
        kinds = set(m.get("a", []))
        if "owl:Class" in kinds:
            v.classes.setdefault(_plain(s), {}).update(described(m) | some(m, ("subclass_of", "rdfs:subClassOf"), ("was", "kg:was"), ("requires", "kg:requires")))
        elif "owl:ObjectProperty" in kinds:
            spec = described(m) | some(m, ("domain", "rdfs:domain"), ("range", "rdfs:range"), ("subproperty_of", "rdfs:subPropertyOf"))
            if "owl:inverseOf" in m:
                spec["inverse"] = names(m, "owl:inverseOf")[0]
            v.properties[_plain(s)] = spec | {k: json.loads(names(m, f"kg:{k}")[0]) for k in ("min", "max") if f"kg:{k}" in m}
        elif kinds & {"owl:DatatypeProperty", "rdf:Property"}:
            for owner in m.get("rdfs:domain", []):
                spec = described(m) | {k: json.loads(names(m, f"kg:{k}")[0]) for k in ("required", "pattern", "min_length", "min_value", "max_value") if f"kg:{k}" in m}
                if "kg:scheme" in m:
                    spec["type"] = "scheme:" + names(m, "kg:scheme")[0]
                elif "kg:value" in m:
                    spec["type"] = "enum:" + "|".join(names(m, "kg:value"))
                elif "rdfs:range" in m:
                    spec["type"] = TYPES.get(m["rdfs:range"][0], "string")
                v.classes.setdefault(_plain(owner), {}).setdefault("attributes", {})[_plain(s[len(owner) :].replace(".", ":", 1) if s.startswith(owner + ".") else s)] = spec
        elif "skos:ConceptScheme" in kinds:
            v.schemes.setdefault(_plain(s), {})
        elif "skos:Concept" in kinds:
            for scheme in m.get("skos:inScheme", []):
                key = lambda x: _plain(x[len(scheme) :].replace(".", ":", 1) if x.startswith(scheme + ".") else x)  # noqa: E731, B023
                spec = described(m) | ({"broader": key(m["skos:broader"][0])} if "skos:broader" in m else {})
                v.schemes.setdefault(_plain(scheme), {})[key(s)] = spec
    return v


def vocabulary_of_rows(rows: DataFrame) -> tuple[Vocabulary, list[str]]:
    """(vocabulary, notes) of a table of terms: kind (class, relation or attribute), name, description, domain, range, inverse.

    An attribute's domain is its class and its range its type.  Repeated terms
    are one, of their least description; domains and ranges are united.  Notes
    name the terms that are left out.
    """
    for c in ("description", "domain", "range", "inverse"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = rows.select(F.lower(t("kind")).alias("kind"), *(t(c).alias(c) for c in ("name", "description", "domain", "range", "inverse")))
    owner = F.when(F.col("kind") == "attribute", F.col("domain")).otherwise("")
    split = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")))))
    least = [F.min(F.when(F.col(c) != "", F.col(c))).alias(c) for c in ("description", "inverse")]
    # What is said more than once is one row before domains and ranges are gathered: a table has a row for each use.
    by = [F.when(F.col("kind") == "property", "relation").otherwise(F.col("kind")).alias("kind"), "name", owner.alias("owner")]
    once = rows.groupBy(*by, "domain", "range").agg(*least)
    found = once.groupBy("kind", "name", "owner").agg(*(F.min(c).alias(c) for c in ("description", "inverse")), split("domain").alias("domain"), split("range").alias("range"), F.max("range").alias("type"))
    found = found.orderBy("kind", "name", "owner").collect()
    v, notes = Vocabulary(), []
    for r in found:
        said = {"definition": r["description"]} if r["description"] else {}
        if not r["name"]:
            notes.append(f"a {r['kind'] or 'term'} without a name")
        elif r["kind"] == "class":
            v.classes.setdefault(r["name"], {}).update(said)
        elif r["kind"] == "relation" and r["domain"]:
            v.properties[r["name"]] = said | {"domain": r["domain"], "range": r["range"]} | ({"inverse": r["inverse"]} if r["inverse"] else {})
        elif r["kind"] == "attribute" and r["owner"]:
            v.classes.setdefault(r["owner"], {}).setdefault("attributes", {})[r["name"]] = said | {"type": r["type"] or "string"}
        elif r["kind"] in ("relation", "attribute"):
            notes.append(f"{r['kind']} {r['name']} without a domain")
        else:
            notes.append(f"{r['name']}: {r['kind'] or 'nothing'} is no kind of term")
    return v, notes


def read_csv(spark: SparkSession, path: str) -> tuple[Vocabulary, list[str]]:
    return vocabulary_of_rows(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_json(text: str) -> Vocabulary:
    """{classes, properties, attributes: {class: {name: spec}}, schemes}, as a vocabulary is configured."""
    said = json.loads(text)
    v = Vocabulary(dict(said.get("classes") or {}), dict(said.get("properties") or {}), {k: dict(s.get("concepts", s)) for k, s in (said.get("schemes") or {}).items()})
    for kind, attributes in (said.get("attributes") or {}).items():
        spec = v.classes.setdefault(kind, {})
        v.classes[kind] = spec | {"attributes": (spec.get("attributes") or {}) | attributes}
    return v


def import_problems(v: Vocabulary) -> list[str]:
    """What is wrong with a vocabulary before it is used: besides ``Vocabulary.problems`` terms without a definition."""
    bare = [f"{n} has no definition" for group in (v.classes, v.properties) for n, spec in group.items() if not (spec.get("definition") or "").strip()]
    return ([] if v.classes else ["no classes"]) + v.problems() + bare
