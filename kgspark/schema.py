"""Columns of the tables that make up a graph, and the fixed words used in them."""

from __future__ import annotations

NODES = (
    "id string, type string, label string, status string, as_of string, valid_from string, valid_to string, "
    "source_doc string, supersedes array<string>, superseded_by string, summary string, attributes string, "
    "tags array<string>, sources array<string>, evidence array<struct<doc: string, where: string, quote: string>>"
)
EDGES = "src string, rel string, dst string, status string, derived_by string, premises array<string>"
ALIASES = "node_id string, alias string, kind string, lang string"
LEXICON = "phrase string, canonical string, target string, status string, note string"
PASSAGES = "path string, title string, body string"
DERIVED = "node_id string, name string, value string, derived_by string, premises array<string>"
FINDINGS = "rule string, severity string, node_id string, message string"

STATUSES = ("current", "superseded", "proposed", "intended")
BELIEVED = ("current",)
BELIEVED_OR_INTENDED = ("current", "intended")
#: Node columns that a pattern may read by name where no attribute has it.
BUILTIN = ("id", "type", "label", "status", "as_of", "valid_from", "valid_to", "source_doc", "superseded_by", "summary")
