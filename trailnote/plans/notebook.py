"""Queries over the note corpus: parsing, writing, classification and conformance.

The corpus is rendered from the orders, so what the parser must give back is known from the
table itself, and SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.functions import markdown as md
from trailnote.operators import linkage, ranking, validation as val
from trailnote.plans.bindings import CLAIMS, NOTE_ID, ORDER_NOTES, day, order_notes
from trailnote.plans.pack import Pack
from trailnote.sources import notefiles, notes
from trailnote.sources.tables import landed, new_folder, table
from trailnote.sources.templates import FIELDS, SECTIONS

pack = Pack()
_KEYS = ("id", "title", "status", "domain", "created_at", "confidence", "source")


@pack.add("""SELECT n_name || '.txt' AS name, 'assumption' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'active' ELSE 'inbox' END AS folder_state, length('# ' || n_name || chr(10) || 'Region ' || n_regionkey)::INT AS n_chars FROM nation""")
def src1_scan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as note files in state folders and scanned again, one row per file."""
    root = new_folder(spark, "notes")
    rows = table(spark, sf_dir, "nation")
    made = rows.select(F.lit("assumption").alias("kind"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("inbox").alias("folder_state"), F.concat(F.lit("# "), "n_name", F.lit("\nRegion "), F.col("n_regionkey").cast("string")).alias("text"))
    notes.write_notes(made, root)
    found = notes.scan_notes(spark, root)
    text = F.regexp_replace("text", r"\n\z", "")
    return found.select(F.concat(F.regexp_extract("text", r"\A# ([^\n]*)", 1), F.lit(".txt")).alias("name"), "kind", "folder_state", F.length(text).alias("n_chars"))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 'id' AS field, id AS value FROM n UNION ALL SELECT path, 'title', 'Order: ' || priority FROM n UNION ALL SELECT path, 'status', status FROM n UNION ALL SELECT path, 'domain', CASE WHEN k % 3 = 0 THEN '-' ELSE priority END FROM n UNION ALL SELECT path, 'created_at', strftime(created, '%Y-%m-%d') FROM n UNION ALL SELECT path, 'confidence', CASE WHEN k % 13 = 0 THEN '1.7' ELSE '0.5' END FROM n UNION ALL SELECT path, 'source', coalesce('derived from ' || derived, '-') FROM n")
def src2_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = notes.headers(order_notes(spark, sf_dir))
    return fm.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(F.col("fm")[k], F.lit("-")).alias("value")) for k in _KEYS])).alias("x")).select("path", "x.*")


@pack.add(f"WITH {ORDER_NOTES} SELECT path, '2020-02-02' AS created FROM n")
def src3_header_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_notes(spark, sf_dir).select("path", day(md.header_date(F.col("text"))).alias("created"))


_HEADS = "(VALUES " + ", ".join(f"({i + 1}, '{h}')" for i, h in enumerate(SECTIONS["assumption"])) + ") h(ord, heading)"


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 0 AS ord, 1 AS level, 'Order: ' || priority AS heading FROM n UNION ALL SELECT path, ord, 2, heading FROM n, {_HEADS} UNION ALL SELECT path, 8, 2, 'Extra Thoughts' FROM n WHERE k % 19 = 0")
def src4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_sections(order_notes(spark, sf_dir)).select("path", "ord", "level", "heading")


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 'Statement' AS heading, 0 AS ord, 0 AS depth, 'Customer: ' || customer AS item FROM n UNION ALL SELECT path, 'Statement', 1, 0, 'Price: ' || price FROM n UNION ALL SELECT path, 'Statement', 2, 1, 'nested' FROM n UNION ALL SELECT path, 'Decision Relevance', 0, 0, 'moves the next order' FROM n WHERE k % 7 <> 0")
def src5_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_items(order_notes(spark, sf_dir))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, customer::VARCHAR AS customer, price::VARCHAR AS price FROM n")
def src6_kv_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = notes.note_sections(order_notes(spark, sf_dir)).filter("heading = 'Statement'").select("path", md.kv_bullets(F.col("body")).alias("m"))
    return body.select("path", F.col("m")["Customer"].alias("customer"), F.col("m")["Price"].alias("price"))


def _customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file per customer with a dated entry for each of up to three nations' worth of fields."""
    c = table(spark, sf_dir, "customer")
    entry = lambda when, what: F.concat(F.lit(f"## {when} - "), F.lit(what), F.lit("\n\n- Decision: "), F.col("c_mktsegment"), F.lit("\n- Outcome:\n- Review date: 2030-01-01\n\n"))
    text = F.concat(F.lit("# Log\n\n## Template\n\n- Decision:\n\n"), entry("2024-01-05", "first"), F.when(F.col("c_custkey") % 2 == 0, entry("2024-02-06", "second")).otherwise(F.lit("")))
    return notes.corpus(c.select(F.concat(F.lit("decisions/log-"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text")))


@pack.add("SELECT 'decisions/log-' || c_custkey || '.md' AS path, '2024-01-05' AS entry_date, 'first' AS title, c_mktsegment AS decision, '-' AS outcome FROM customer UNION ALL SELECT 'decisions/log-' || c_custkey || '.md', '2024-02-06', 'second', c_mktsegment, '-' FROM customer WHERE c_custkey % 2 = 0")
def src7_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.log_entries(_customer_log(spark, sf_dir))
    return rows.select("path", day("entry_date").alias("entry_date"), "title", F.col("fields")["Decision"].alias("decision"), F.coalesce(F.col("fields")["Outcome"], F.lit("-")).alias("outcome"))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 0 AS row_no, 'state' AS first, 'price' AS second FROM n UNION ALL SELECT path, 1, state, '`a|' || price || '`' FROM n")
def src8_md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.table_rows(order_notes(spark, sf_dir)).select("path", "row_no", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool file per supplier."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("# Pool\n\n## Track A\n\n1. "), F.col("s_name"), F.lit("\n   - Link: https://x.example/"), key, F.lit("\n   - Why: cheap\n2. Other: part\n\n### Group\n\n1. Third\n   - Why:\n\n## Track B\n\n7. Last\n   - Link: y\n"))
    return notes.corpus(table(spark, sf_dir, "supplier").select(F.concat(F.lit("learning/pool-"), key, F.lit(".md")).alias("path"), text.alias("text")))


@pack.add("""WITH p AS (SELECT 'learning/pool-' || s_suppkey || '.md' AS path, * FROM supplier)
SELECT path, 'Track A' AS track, '-' AS grp, 1 AS rank, s_name AS title, 'https://x.example/' || s_suppkey AS link, 'cheap' AS why FROM p UNION ALL SELECT path, 'Track A', '-', 2, 'Other: part', '-', '-' FROM p
UNION ALL SELECT path, 'Track A', 'Group', 1, 'Third', '-', '-' FROM p UNION ALL SELECT path, 'Track B', '-', 7, 'Last', 'y', '-' FROM p""")
def src9_pool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.pool_items(_pool(spark, sf_dir))
    return rows.select("path", "track", F.coalesce("grp", F.lit("-")).alias("grp"), "rank", "title", F.coalesce("link", F.lit("-")).alias("link"), F.coalesce("why", F.lit("-")).alias("why"))


_LINKS = "SELECT path, 'assumptions/index.md' AS target, 'link' AS type FROM n UNION ALL SELECT path, 'assumptions/' || state || '/notes/plan.md', 'path' FROM n UNION ALL SELECT path, id, 'id' FROM n WHERE id LIKE 'A-%' UNION ALL SELECT path, derived, 'id' FROM n WHERE derived LIKE 'A-%'"


@pack.add(f"WITH {ORDER_NOTES} {_LINKS}")
def src10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_links(order_notes(spark, sf_dir)).select("path", "target", "type")


@pack.add(f"WITH {ORDER_NOTES} SELECT id, id[1:1] AS prefix, strftime(created, '%Y-%m-%d') AS date, 'order-' || k AS slug, id[1:1] = 'A' AS known FROM n")
def src11_parse_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.ids_of(order_notes(spark, sf_dir)).select("id", "prefix", day("date").alias("date"), "slug", "known")


@pack.add("""SELECT 'principles/inbox/P-20240101-part-' || p_partkey || '.md' AS path,
'---' || chr(10) || 'id: P-20240101-part-' || p_partkey || chr(10) || 'title: ' || p_name || chr(10) || 'status: inbox' || chr(10) || 'validated_at:' || chr(10) || 'validity_scope: always' || chr(10) || 'confidence:' || chr(10) || 'derived_from:' || chr(10) || 'recheck_at:' || chr(10) || '---' || chr(10) || chr(10) || '# ' || p_name || chr(10)
|| chr(10) || '## Principle Statement' || chr(10) || chr(10) || '- ' || p_type || chr(10) || chr(10) || '## Why I Trust It' || chr(10) || chr(10) || chr(10) || '## Supporting Evidence' || chr(10) || chr(10) || chr(10) || '## Boundary Conditions' || chr(10) || chr(10) || chr(10) || '## How It Should Change Decisions' || chr(10) || chr(10) AS text FROM part""")
def snk1_new_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    values = {"id": F.concat(F.lit("P-20240101-part-"), F.col("p_partkey").cast("string")), "title": F.col("p_name"), "status": F.lit("inbox"), "validity_scope": F.lit("always")}
    return notes.new_note(rows, "principle", values, {"Principle Statement": F.concat(F.lit("- "), "p_type")}).select("path", "text")


@pack.add("""SELECT 'assumptions/active/s' || s_suppkey || '.md' AS path, 'active' AS folder_state, 'assumptions/' || CASE WHEN (s_suppkey + 1) % 3 = 0 THEN 'inbox' ELSE 'active' END || '/s' || (s_suppkey + 1) || '.md' AS target,
(s_suppkey + 1) IN (SELECT s_suppkey FROM supplier) AS resolves FROM supplier WHERE s_suppkey % 3 <> 0""")
def snk1_note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as notes that point at the next one, written as files under their own paths; of the active folder's notes, read back alone, which links resolve."""
    root = new_folder(spark, "note-files")
    place = lambda k: F.concat(F.when(k % 3 == 0, "inbox").otherwise("active"), F.lit("/s"), k.cast("string"), F.lit(".md"))
    key = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(F.concat(F.lit("assumptions/"), place(key)).alias("path"), F.concat(F.lit("# "), "s_name", F.lit("\n\nNext: [note](../"), place(key + 1), F.lit(")\n")).alias("text"))
    notefiles.write_note_files(made, root)
    known = notefiles.read_note_files(spark, root).select(F.col("path").alias("target"), F.lit(True).alias("resolves"))
    links = notes.note_links(notefiles.read_note_files(spark, root).filter("folder_state = 'active'"))
    return links.join(known, "target", "left").select("path", F.lit("active").alias("folder_state"), "target", F.coalesce("resolves", F.lit(False)).alias("resolves"))


@pack.add("SELECT CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'under re-check' END AS status, 'P-' || o_orderkey AS id, '- [' || o_orderpriority || '](P-' || o_orderkey || '.md)' AS line FROM orders WHERE o_totalprice > 400000")
def snk3_rebuild_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("re-check").alias("status"))
    return notes.rebuilt_index(rows)


# FIL: classification and conformance

_KIND_SQL = r"""CASE WHEN regexp_matches(lower(text), '\b((last|this|past) (week|month|quarter|year)|looking back|in review|retrospective)\b') THEN 'periodic review'
WHEN regexp_matches(lower(text), '\b(i am (a|an|now)|my (role|goals?|values|strengths?|constraints?|preferences?) (is|are|changed)|i now (live|work|prefer|value))\b') THEN 'profile update'
WHEN regexp_matches(lower(text), '\b(observed|measured|noticed|recorded|saw that|found that|results? (was|were))\b') THEN 'evidence capture'
WHEN regexp_matches(lower(text), '\b(test (it|whether|if)|try (it|out)|experiment|trial|pilot|for (the next )?[0-9]+ (days|weeks))\b') THEN 'experiment design'
WHEN regexp_matches(lower(text), '\b(always|never|rule of thumb|as a rule|principle|from now on)\b') THEN 'principle synthesis'
WHEN regexp_matches(lower(text), '\b(i (believe|think|suspect|assume|guess)|hypothesis|assumption|probably|might be)\b') THEN 'new assumption' ELSE 'unclassified' END"""
_SAYINGS = ("I believe it holds", "We measured 3", "Always sleep first", "let us test whether it holds", "I am now a lead", "looking back at it", "nothing of note", "My goals changed", "walk for 14 days", "it might be late")
_SAY = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SAYINGS)) + " END"


def _sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _SAYINGS)), (F.col("event_id") % 10).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


@pack.add(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND_SQL} AS kind FROM (SELECT {_SAY} AS text FROM events)) GROUP BY kind")
def fil1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sayings(spark, sf_dir).groupBy(val.classify(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@pack.add(f"SELECT event_id, 0 AS ord, {_SAY} AS unit, {_KIND_SQL.replace('text', _SAY)} AS kind FROM events UNION ALL SELECT event_id, 1, 'we measured it', 'evidence capture' FROM events UNION ALL SELECT event_id, 2, 'plain', 'unclassified' FROM events")
def fil2_split_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _sayings(spark, sf_dir).select("event_id", F.concat("text", F.lit("\n- we measured it\n\n\nplain\n")).alias("text"))
    return val.split_input(mixed, "event_id")


@pack.add(f"WITH {ORDER_NOTES} SELECT path, k % 7 <> 0 AS relevant FROM n")
def fil3_decision_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.relevant(order_notes(spark, sf_dir))


@pack.add("SELECT o_orderkey AS id, (o_totalprice > 100000)::INT + (o_orderpriority <> '5-LOW')::INT + (o_orderstatus <> 'P')::INT AS score, o_totalprice > 100000 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AS passed FROM orders")
def fil4_assumption_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return val.assumption_quality(rows, specific=F.col("o_totalprice") > 100000, relevant=F.col("o_orderpriority") != "5-LOW", grounded=F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"), "score", "passed")


@pack.add("SELECT score, count(*) AS n, count(*) FILTER (score = 4) AS passed FROM (SELECT (l_extendedprice < 50000)::INT + (l_quantity < 10)::INT + (l_discount > 0)::INT + (l_returnflag <> 'R')::INT AS score FROM lineitem) GROUP BY score")
def fil5_experiment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return val.experiment_quality(rows, cheap=F.col("l_extendedprice") < 50000, short=F.col("l_quantity") < 10, clear=F.col("l_discount") > 0, reversible=F.col("l_returnflag") != "R").groupBy("score").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


_FIVE = {"fits the track": "p_size < 25", "short": "p_retailprice < 1000", "primary": "p_type = 'ECONOMY'", "named": "p_name LIKE 'red%'", "fresh": "p_brand < 'Brand#2'"}


@pack.add(f"SELECT p_partkey, {' + '.join(f'({c})::INT' for c in _FIVE.values())} AS score FROM part WHERE {' + '.join(f'({c})::INT' for c in _FIVE.values())} >= 2")
def fil6_k_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.judged(table(spark, sf_dir, "part"), {k: F.expr(c) for k, c in _FIVE.items()}, least=2).filter("passed").select("p_partkey", "score")


@pack.add("SELECT p_partkey FROM part WHERE NOT (p_size > 40 OR p_type = 'PROMO' OR p_name LIKE '%widget')")
def fil7_deprioritise(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("p_size") > 40, F.col("p_type") == "PROMO", F.col("p_name").like("%widget")]
    return table(spark, sf_dir, "part").filter(val.excluded(flags)).select("p_partkey")


@pack.add("SELECT c_custkey, CASE WHEN c_acctbal < 1000 OR (CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END) < 3 THEN 'drop' WHEN c_nationkey % 5 = 0 THEN 'unknown' ELSE 'continue' END AS verdict FROM customer")
def fil8_threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = {"balance": (F.col("c_acctbal"), 1000), "place": (F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey")), 3)}
    return table(spark, sf_dir, "customer").select("c_custkey", val.gate(measures).alias("verdict"))


_ALWAYS_EMPTY = [f for f in FIELDS["assumption"] if f not in _KEYS]


@pack.add(f"WITH {ORDER_NOTES} SELECT path, name FROM n, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in _ALWAYS_EMPTY)}) m(name) UNION ALL SELECT path, 'domain' FROM n WHERE k % 3 = 0 UNION ALL SELECT path, 'source' FROM n WHERE k % 4 <> 0 OR k = 0")
def fil9_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.missing_fields(order_notes(spark, sf_dir)).select("path", "name")


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 'Extra Thoughts' AS heading, 'extra' AS finding FROM n WHERE k % 19 = 0")
def fil10_section_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.section_conformance(order_notes(spark, sf_dir))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, state AS folder_state, status FROM n WHERE state <> status")
def fil11_state_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.state_conflicts(order_notes(spark, sf_dir))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, 'unknown prefix' AS rule, id AS detail FROM n WHERE k % 17 = 0 UNION ALL SELECT path, 'confidence', '1.7' FROM n WHERE k % 13 = 0")
def fil11_value_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.value_findings(order_notes(spark, sf_dir))


@pack.add(f"WITH {ORDER_NOTES} SELECT path, heading FROM n, (VALUES ('What Would Make It True'), ('What Would Falsify It'), ('Minimal Test')) h(heading) UNION ALL SELECT path, 'Decision Relevance' FROM n WHERE k % 7 = 0 UNION ALL SELECT path, 'Order: ' || priority FROM n")
def fil12_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.placeholders(order_notes(spark, sf_dir))


# Links inside the corpus


@pack.add(f"WITH {ORDER_NOTES}, l AS ({_LINKS}) SELECT path, target, type FROM l WHERE target NOT IN (SELECT id FROM n)")
def j7_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rendered once; both readings are of the stored texts.
    corpus = landed(order_notes(spark, sf_dir), "note-corpus")
    known = notes.ids_of(corpus).select(F.col("id").alias("target"))
    return linkage.dangling(notes.note_links(corpus), known).select("path", "target", "type")


@pack.add(f"WITH {ORDER_NOTES} SELECT id, derived AS source FROM n WHERE derived LIKE 'A-%'")
def j6_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.lineage(notes.typed(order_notes(spark, sf_dir), "assumption"))


@pack.add(f"""WITH {CLAIMS} SELECT {NOTE_ID.format(k="id", d="created")} AS id, strftime(created, '%Y-%m-%d') AS created_at, CASE WHEN id % 13 = 0 THEN 1.7 ELSE 0.5 END::DOUBLE AS confidence, '-' AS strength FROM c
UNION ALL SELECT 'EV-' || l_orderkey || '-' || l_linenumber, '-', NULL, l_returnflag FROM lineitem""")
def set1_union_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = notes.typed(order_notes(spark, sf_dir), "assumption").select("id", day("created_at").alias("created_at"), "confidence")
    b = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.lit("EV"), "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("strength"))
    both = ranking.united(a, b)
    return both.select("id", F.coalesce("created_at", F.lit("-")).alias("created_at"), "confidence", F.coalesce("strength", F.lit("-")).alias("strength"))
