"""Column expressions of the graph's value semantics.

A value is held as JSON text, which tells strings, numbers, booleans and lists
apart.  A missing value fails every comparison but ``exists``, also ``!=`` and
``not_in``, so comparisons here are never null.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.schema import BUILTIN

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TODAY = re.compile(r"\$today(?:-(\d+)d)?")


@dataclass(frozen=True)
class Value:
    """A value as JSON text, and as plain text (strings without quotes)."""

    json: Column
    text: Column

    @property
    def head(self) -> Column:
        return F.substring(self.json, 1, 1)

    @property
    def number(self) -> Column:
        """Booleans count as 1 and 0, and strings that read as numbers as those."""
        return F.when(self.json == "true", 1.0).when(self.json == "false", 0.0).otherwise(self.text.try_cast("double"))

    @property
    def numeric(self) -> Column:
        return self.head.isin("t", "f", "-", *"0123456789")


def of_text(column: Column) -> Value:
    return Value(F.concat(F.lit('"'), column, F.lit('"')), column)


def of_json(column: Column) -> Value:
    """From JSON text, as derived attributes keep it."""
    return Value(F.when(column != "null", column), F.get_json_object(F.concat(F.lit('{"v":'), column, F.lit("}")), "$.v"))


def attribute(name: str, attributes: str | Column = "attributes") -> Value:
    path = f"$.{re.sub('[^A-Za-z0-9_]', '', name)}"
    found = F.try_variant_get(F.try_parse_json(F.col(attributes) if isinstance(attributes, str) else attributes), path, "variant")
    text = F.to_json(found)
    return Value(F.when(text != "null", text), F.get_json_object(attributes, path))


def reading(name: str, columns: list[str], was: dict | None = None, default=None, declared: bool = False, derived: Value | None = None) -> Value:
    """The asserted value (a former one as what it became), else the derived one, the default, the built-in column."""
    v = attribute(name)
    text, js = v.text, v.json
    for old, new in (was or {}).items():
        hit = v.json == json.dumps(old)
        text, js = F.when(hit, F.lit(new)).otherwise(text), F.when(hit, F.lit(json.dumps(new))).otherwise(js)
    parts = [(js, text)]
    if derived is not None:
        parts.append((derived.json, derived.text))
    if default is not None:
        parts.append((F.lit(json.dumps(default)), F.lit(str(default))))
    if name in BUILTIN and name in columns and not declared:
        parts.append((of_text(F.col(name)).json, F.col(name)))
    return Value(F.coalesce(*(p[0] for p in parts)), F.coalesce(*(p[1] for p in parts)))


def today() -> datetime.date:
    pinned = os.environ.get("KGSPARK_TODAY")
    return datetime.date.fromisoformat(pinned) if pinned else datetime.date.today()


def resolved(expected):
    """``$today`` and ``$today-<n>d`` as ISO dates, anything else as it is."""
    if isinstance(expected, str) and (m := _TODAY.fullmatch(expected)):
        return (today() - datetime.timedelta(days=int(m[1] or 0))).isoformat()
    return expected


def equals(value: Value, expected) -> Column:
    if isinstance(expected, Value):
        same = F.when(value.numeric & expected.numeric, value.number == expected.number).otherwise(value.json == expected.json)
    elif isinstance(expected, str):
        same = (value.head == '"') & (value.text == expected)
    elif isinstance(expected, (bool, int, float)):
        same = value.numeric & (value.number == float(expected))
    else:
        same = value.json == json.dumps(expected, separators=(",", ":"), ensure_ascii=False)
    return F.coalesce(same, F.lit(False))


def compare(op: str, value: Value, expected) -> Column:
    """One of = != in not_in contains exists < <= > >=, as a column that is never null."""
    there = value.json.isNotNull()
    if op == "exists":
        full = F.coalesce(there & (value.text != "") & (value.json != "[]"), F.lit(False))
        return full if expected else ~full
    expected = resolved(expected)
    if op == "=":
        return equals(value, expected)
    if op == "!=":
        return there & ~equals(value, expected)
    if op in ("in", "not_in"):
        some = F.lit(False)
        for x in expected if isinstance(expected, list) else [expected]:
            some = some | equals(value, resolved(x))
        return some if op == "in" else there & ~some
    text = expected.text if isinstance(expected, Value) else F.lit(str(expected))
    if op == "contains":
        within = F.when(value.head == '"', F.contains(value.text, text)).when(
            value.head == "[", F.array_contains(F.from_json(value.json, "array<string>"), text)
        )
        return F.coalesce(within, F.lit(False))
    number = expected.number if isinstance(expected, Value) else text.try_cast("double")
    dates = (value.head == '"') & value.text.rlike(ISO_DATE) & text.rlike(ISO_DATE)
    sides = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    order = sides[op]
    return F.coalesce(F.when(dates, order(value.text, text)).otherwise(order(value.number, number)), F.lit(False))


def present(value: Value) -> Column:
    return F.coalesce(value.json.isNotNull() & (value.text != "") & ~value.json.isin("[]", "{}"), F.lit(False))


def valid_on(day: str | Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Half open: from valid_from on, and before valid_to; null has no limit."""
    day = F.lit(day) if isinstance(day, str) else day
    begun = F.col(valid_from).isNull() | (F.col(valid_from) <= day)
    return begun & (F.col(valid_to).isNull() | (F.col(valid_to) > day))


def type_fits(kind: str, value: Value) -> Column:
    """Whether a value has an attribute's declared type; absent and empty ones always do."""
    string, number = value.head == '"', value.head.isin("-", *"0123456789")
    if kind.startswith("enum:"):
        fits = string & value.text.isin([x.strip() for x in kind[5:].split("|")])
    else:
        fits = {
            "string": string,
            "number": number,
            "integer": number & ~value.json.rlike("[.eE]"),
            "boolean": value.json.isin("true", "false"),
            "date": string & value.text.rlike(ISO_DATE),
            "list": value.head == "[",
        }.get(kind, F.lit(True))
    return F.coalesce(fits | (value.text == ""), F.lit(True))


def value_problem(spec: dict, value: Value) -> Column:
    """Whether a value, or a list's value, breaks pattern, min_length, min_value or max_value (false where absent)."""

    def broken(text: Column, is_text: Column) -> Column:
        out = F.lit(False)
        if spec.get("pattern") is not None:
            out = out | ~text.rlike(spec["pattern"])
        if spec.get("min_length") is not None:
            out = out | (F.length(text) < spec["min_length"])
        for key, wrong in (("min_value", lambda a, b: a < b), ("max_value", lambda a, b: a > b)):
            bound = spec.get(key)
            if isinstance(bound, str):
                out = out | (is_text & text.rlike(ISO_DATE) & wrong(text, F.lit(bound)))
            elif bound is not None:
                number = text.try_cast("double")
                out = out | number.isNull() | wrong(number, F.lit(float(bound)))
        return out

    items = F.from_json(value.json, "array<string>")
    many = F.exists(items, lambda x: F.coalesce((x != "") & broken(x, F.lit(True)), F.lit(False)))
    one = (value.text != "") & broken(value.text, value.head == '"')
    return F.coalesce(F.when(value.head == "[", many).otherwise(one), F.lit(False))


# Names as words, slugs and identifiers.


def name_as_words(name: Column) -> Column:
    """camelCase and snake_case as lower-case words."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def edge_key(src: str = "src", rel: str = "rel", dst: str = "dst") -> Column:
    return F.concat(F.col(src), F.lit(" -"), F.col(rel), F.lit("-> "), F.col(dst))
