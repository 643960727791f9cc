"""Decision records and figures taken from Markdown."""

from kgspark.sources import markdown

GOOD = """---
# a note
id: ADR-7
title: "Take the lift"
status: accepted
decided_on: 2024-05-01
decided_by: Ann
governs: [part.1, 'Lift', Nothing]
about:
  - role.x
  - "TEAM y"
supersedes: adr-3
---

# Lift

## Context
None.

## Decision
We take the lift. It is
faster.

### Later
Nothing.
"""
TEXTS = [
    (1, GOOD),
    (2, GOOD.replace("id: ADR-7", "id: ADR-8").replace("supersedes: adr-3\n", "supersedes: ADR-99\n").replace('title: "Take the lift"\n', "")),
    (3, "---\nid: ADR-x\nstatus: open\ndecided_on: May\nowner: me\nabout: one\nsupersedes: 3\ngoverns:\n  a: b\n---\ntext\n"),
    (4, "# Title\n\n## Decision\nNone."),
    (5, ""),
    (6, None),
    (7, "---\nid: ADR-9\nstatus: proposed\ndecided_on: 2024-01-02\nid: ADR-10\n---\n# T\n## Decision\nfirst\n## Decision\nlast words"),
]


def test_records(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r["doc"]: r for r in markdown.records(docs).collect()}
    one = got[1]
    assert one["is_record"] and one["problems"] == [] and one["title"] == "Take the lift" and one["quote"] == "We take the lift." and one["decision"] == "We take the lift. It is faster."
    assert one["governs"] == ["part.1", "Lift", "Nothing"] and one["about"] == ["role.x", "TEAM y"] and one["resolves"] == [] and one["supersedes"] == "adr-3"
    assert got[2]["title"] == "Lift" and got[2]["problems"] == []
    assert got[3]["problems"] == [
        "field not known: owner", "neither a value nor a list: governs", "id is not ADR and a number", "status is not one of proposed, accepted", "decided_on is not a day",
        "not a list: governs", "not a list: about", "supersedes is not ADR and a number", "no section Decision", "no title",
    ]
    assert all(got[k]["problems"] == ["no fields"] and not got[k]["is_record"] for k in (4, 5, 6))
    assert got[7]["id"] == "ADR-10" and got[7]["quote"] == "last words" and got[7]["problems"] == []


def test_proposal(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    graph = spark.createDataFrame(
        [("part.1", "x", []), ("role.b", "Lift", []), ("role.a", "lift", ["Lift"]), ("role.x", None, None), ("team.y", "team y", []), ("decision.adr-3", "Old", []), ("p.ann", "Annabel", ["ann"])],
        "id string, label string, aliases array<string>",
    )
    nodes, edges, unresolved = markdown.proposal(markdown.records(docs), graph)
    rows = {r["id"]: r for r in nodes.collect()}
    assert set(rows) == {"decision.adr-7", "document.1", "decision.adr-8", "document.2", "decision.adr-3", "decision.adr-10", "document.7"}
    assert rows["decision.adr-3"]["status"] == "superseded" and rows["decision.adr-3"]["superseded_by"] == "decision.adr-7" and rows["decision.adr-3"]["valid_to"] == "2024-05-01"
    assert rows["decision.adr-7"]["supersedes"] == "decision.adr-3" and rows["decision.adr-8"]["supersedes"] is None
    got = {tuple(r)[:3] for r in edges.collect()}
    assert {x for x in got if x[0] == "decision.adr-7"} == {
        ("decision.adr-7", r, d) for r, d in [("governs", "part.1"), ("governs", "role.a"), ("about", "role.x"), ("about", "team.y"), ("decided_by", "p.ann"), ("documented_in", "document.1")]
    }
    assert {tuple(r) for r in unresolved.collect()} == {(1, "governs", "Nothing"), (2, "governs", "Nothing"), (2, "supersedes", "decision.adr-99")}
    assert [df.count() for df in markdown.proposal(markdown.records(docs.limit(0)), graph)] == [0, 0, 0]


def _figure(n, reasons="arrows", pending=True):
    return f"> **[DIAGRAM]** ({reasons}) — see `assets/deck/slide-{n:02d}.png`." + (" _Description added in review pass._" if pending else "")


def test_figures(spark):
    text = "\n".join(
        ["## Slide 1 — Flow", _figure(1), "- Start 10", "text", "- " + "x" * 200, "- End 3", "## Slide 2", _figure(2), "none", "## Slide 3 — Done", _figure(3, pending=False), ">", "> " + markdown.SUMMARY + markdown.NO_LABELS]
        + [_figure(4, pending=False), ">", "> **Description:** a chart", "   ", _figure(5)] + ["line"] * 29 + ["- too far"]
    )
    docs = spark.createDataFrame([(1, text), (2, "no figure"), (3, None), (4, "")], "doc_id long, text string")
    curated = spark.createDataFrame([("deck#2", "Two boxes."), ("deck#9", "None.")], "key string, description string")
    rows = {r["key"]: r for r in markdown.figures(docs, curated=curated).collect()}
    assert {k: (r["title"], r["labelled"], r["curated"]) for k, r in rows.items()} == {
        "deck#1": ("Flow", True, False), "deck#2": ("", False, True), "deck#3": ("Done", False, False), "deck#5": ("Done", False, False),
    }
    assert rows["deck#1"]["image"] == "assets/deck/slide-01.png" and rows["deck#1"]["reasons"] == "arrows"
    out = markdown.described(docs, curated).collect()
    assert len(out) == 1 and (out[0]["n_curated"], out[0]["n_auto"]) == (1, 2)
    lines = out[0]["text"].split("\n")
    assert lines[1:4] == [_figure(1, pending=False), ">", "> " + markdown.SUMMARY + "Diagram titled “Flow”. Key on-slide elements: Start 10; End 3."]
    assert "> **Description:** Two boxes." in lines and lines[-1] == "- too far" and len(lines) == len(text.split("\n")) + 6
    again = markdown.figures(spark.createDataFrame([(1, out[0]["text"])], "doc_id long, text string"))
    assert {r["key"] for r in again.collect()} == {"deck#3", "deck#5"}


def test_documents_are_taken_apart_once(spark):
    docs = spark.createDataFrame([(1, "---\nid: ADR-1\nstatus: accepted\ndecided_on: 2024-01-01\nabout: [x]\n---\n# T\n## Decision\nDo.\n")], "doc_id long, text string")
    parts = markdown.proposal(markdown.records(docs), spark.createDataFrame([("x", "X")], "id string, label string"))
    assert [df.count() for df in parts] == [2, 2, 0]
    assert not any("regexp" in df._jdf.queryExecution().optimizedPlan().toString() for df in parts)
