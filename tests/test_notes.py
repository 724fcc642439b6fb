"""Parsing, checking and writing notes, on invented ones with a defect each."""

import datetime

import pytest
from pyspark.sql import functions as F

from trailnote.operators import lifecycle as lc, linkage, validation as val
from trailnote.sources import notes

GOOD = """---
id: A-20240101-walks
title: Walks: do they help?
status: active
created_at: 2024-01-01
confidence: 0.5
source: derived from A-20231231-sleep and EV-20240101-log
supersedes:
---

# Walks: do they help?

## Statement

- they help
  - a lot
-
1. numbered

## Décision 决定

See [plan](../../experiments/E-20240102-plan.md) and `evidence/x.md`, https://x.example.

```text
## not a heading
- not an item
```

| a | b |
|---|:-:|
| 1 | `x|y` |
| 2 \\| 3 |  |

## Minimal Test
- Cost: low: very
- Owner:
"""
PLAIN = "# Old\nCreated: 2023-05-06\r\n\r\nNo header here.\n"
BAD = "---\nid: Z-2024-x\nstatus: done\nconfidence: 1.7\n---\n## Statement\n-\n## Own Section\ntext\n"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("assumptions/inbox/good.md", GOOD), ("principles/old.md", PLAIN), ("assumptions/active/bad.md", BAD), ("learning/current-pool.md", None), ("assumptions/archived/empty.md", "")]
    return notes.corpus(spark.createDataFrame(rows, "path string, text string"))


def test_kinds_and_states(corpus):
    assert {r.path.rsplit("/", 1)[1]: (r.kind, r.folder_state) for r in corpus.collect()} == {"good.md": ("assumption", "inbox"), "old.md": ("principle", None), "bad.md": ("assumption", "active"), "current-pool.md": ("learning_current_pool", None), "empty.md": ("assumption", "archived")}


def test_headers(corpus):
    good = notes.typed(corpus, "assumption").filter("id = 'A-20240101-walks'").first()
    assert good.title == "Walks: do they help?" and good.created_at == datetime.date(2024, 1, 1) and good.confidence == 0.5 and good.supersedes is None and good.review_at is None
    from trailnote.functions import markdown as md

    dates = {r.path: r.d for r in corpus.select("path", md.header_date(F.col("text")).alias("d")).collect()}
    assert dates["principles/old.md"] == datetime.date(2023, 5, 6) and dates["assumptions/inbox/good.md"] is None


def test_sections_items_tables_links(corpus):
    good = corpus.filter("path LIKE '%good.md'")
    parts = notes.note_sections(good).orderBy("ord").collect()
    assert [(r.level, r.heading) for r in parts] == [(1, "Walks: do they help?"), (2, "Statement"), (2, "Décision 决定"), (2, "Minimal Test")]
    assert "## not a heading" in parts[2].body
    items = [(r.heading, r.depth, r.item) for r in notes.note_items(good).orderBy("heading", "ord").collect()]
    assert items == [("Minimal Test", 0, "Cost: low: very"), ("Minimal Test", 0, "Owner:"), ("Statement", 0, "they help"), ("Statement", 1, "a lot"), ("Statement", 0, "numbered")]
    rows = [r.cells for r in notes.table_rows(good).orderBy("table_no", "row_no").collect()]
    assert rows == [["a", "b"], ["1", "`x|y`"], ["2 \\| 3", ""]]
    links = {(r.type, r.target) for r in notes.note_links(good).collect()}
    assert links >= {("link", "experiments/E-20240102-plan.md"), ("path", "assumptions/inbox/evidence/x.md"), ("id", "A-20231231-sleep"), ("id", "EV-20240101-log"), ("id", "E-20240102-plan")}
    assert {r.source for r in linkage.lineage(notes.typed(good, "assumption")).collect()} == {"A-20231231-sleep", "EV-20240101-log"}


def test_findings(corpus):
    assert {(r.rule, r.detail) for r in val.value_findings(corpus.filter("path LIKE '%bad.md'")).collect()} == {("unknown prefix", "Z-2024-x"), ("unknown status", "done"), ("confidence", "1.7")}
    assert {r.path for r in val.value_findings(corpus).filter("rule = 'no header'").collect()} == {"principles/old.md", "learning/current-pool.md", "assumptions/archived/empty.md"}
    assert {(r.folder_state, r.status) for r in val.state_conflicts(corpus).collect()} == {("inbox", "active"), ("active", "done"), ("archived", None)}
    extra = {(r.heading, r.finding) for r in val.section_conformance(corpus.filter("path LIKE '%bad.md'")).collect()}
    assert ("Own Section", "extra") in extra and ("Notes", "missing") in extra and ("Statement", "missing") not in extra
    assert [r.heading for r in val.placeholders(corpus.filter("path LIKE '%bad.md'")).collect()] == ["Statement"]
    assert {r.name for r in val.missing_fields(corpus.filter("path LIKE '%bad.md'")).collect()} >= {"title", "domain"}


def test_logs_and_pools(spark):
    text = "# L\n## 2024-02-30 - no date\n- Decision: x\n## 2024-02-28 - yes\n- Decision: a: b\n- Outcome:\n## Other\n- Decision: z\n"
    rows = notes.log_entries(notes.corpus(spark.createDataFrame([("decisions/d.md", text)], "path string, text string"))).orderBy("ord").collect()
    assert [(r.entry_date, r.title, r.fields["Decision"], r.fields.get("Outcome")) for r in rows] == [(None, "no date", "x", None), (datetime.date(2024, 2, 28), "yes", "a: b", None)]


def test_write_and_scan(spark, corpus, tmp_path):
    root = f"file://{tmp_path}/a b+c"
    notes.write_notes(corpus.filter("text <> ''"), root)
    found = {(r.kind, r.folder_state): r.text for r in notes.scan_notes(spark, root).collect()}
    assert set(found) == {("assumption", "inbox"), ("principle", None), ("assumption", "active")}
    assert found["assumption", "inbox"].rstrip("\n") == GOOD.rstrip("\n")
    assert notes.scan_notes(spark, f"{tmp_path}/nothing").schema.simpleString() == "struct<path:string,kind:string,folder_state:string,text:string>"


def test_new_note_parses_back(spark):
    rows = spark.createDataFrame([("A-20240101-x", "T: u")], "id string, title string")
    made = notes.new_note(rows, "assumption", {"id": F.col("id"), "title": F.col("title"), "status": F.lit("inbox")}, {"Statement": F.lit("- s")})
    back = notes.typed(made, "assumption").first()
    assert (back.id, back.title, back.status, back.folder_state) == ("A-20240101-x", "T: u", "inbox", "inbox")
    assert val.section_conformance(made).count() == 0 and val.state_conflicts(made).count() == 0


def test_chains_and_cycles(spark):
    edges = [(i + 1, i) for i in range(1, 20)] + [(31, 30), (30, 31), (40, None), (33, 30)]
    got = {r.id: (r.latest, r.hops, r.cyclic) for r in linkage.chain_ends(spark.createDataFrame(edges, "id long, supersedes long")).collect()}
    assert all(got[i] == (20, 20 - i, False) for i in range(1, 21)) and got[40] == (40, 0, False)
    assert got[30][0] is None and got[31][2] and got[33] == (33, 0, False)


def test_guards(spark):
    current = spark.createDataFrame([(1, "inbox"), (2, "inbox"), (3, "active"), (4, "active"), (5, "verified")], "id long, state string")
    requests = spark.createDataFrame([(1, "active", 1), (2, "active", 1), (3, "verified", 1), (4, "verified", 1), (5, "active", 1), (6, "active", 1)], "id long, to_state string, at long")
    plans = spark.createDataFrame([(1,), (1,), (6,)], "related_assumption long")
    backing = spark.createDataFrame([(3, 1), (4, 2)], "id long, n long")
    assert {r.id: r.refused for r in lc.requested(current, requests, plans, backing).collect()} == {1: None, 2: "no plan", 3: "too little evidence", 4: None, 5: "no such move", 6: None}


def test_as_of_carries_across_ranges(spark):
    facts = spark.createDataFrame([(i, i) for i in range(200)], "k long, t long").repartition(7)
    periods = spark.createDataFrame([(10, 50, "x"), (60, None, "y")], "start long, end long, name string")
    got = {r.k: r.name for r in linkage.in_period(facts, periods, "t").collect()}
    assert got == {i: None if i < 10 or 50 <= i < 60 else "x" if i < 60 else "y" for i in range(200)}
