"""The test tables as trajectories, notes, evidence and logs.

Names on the left are the library's, those on the right the tables': events are trajectories
(run = user), orders are claims with a lifecycle, lines are evidence for them, and every order
also stands as a Markdown note that the corpus functions take apart again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.operators import trajectory as tr
from trailnote.operators.lifecycle import evidence_strength
from trailnote.sources import notes
from trailnote.sources.tables import table

GOALS, FAILURES = ("purchase",), ("error",)
AS_OF = "1999-01-01"


def day(column: str | Column) -> Column:
    """A date as text, which both engines print alike."""
    return F.date_format(column, "yyyy-MM-dd")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").alias("cost"), F.when(F.col("value") > 20, "high").otherwise("low").alias("action"), (F.col("user_id") % 2).alias("variant"))
    return tr.indexed(events, "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"), keep=("cost", "action", "variant"))


TRAJECTORY = """e AS (SELECT user_id AS run_id, event_type AS state, value AS cost, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS action, user_id % 2 AS variant,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
  lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS has_next FROM events)"""
TAUS = TRAJECTORY + """, r AS (SELECT run_id, variant, count(*) AS n_steps, min(step) FILTER (state = 'purchase') AS tau_g, min(step) FILTER (state = 'error') AS tau_f, sum(cost) AS cost,
  count(*) FILTER (has_next AND state = next_state) AS retries, count(*) FILTER (state = 'error') AS errors FROM e GROUP BY ALL),
  h AS (SELECT *, tau_g IS NOT NULL AND (tau_f IS NULL OR tau_g < tau_f) AS ok FROM r)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, state, created, priority, price, customer)."""
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "inbox").otherwise("falsified")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), F.to_date("o_orderdate").alias("created"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))


CLAIMS = """c AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'inbox' ELSE 'falsified' END AS state, o_orderdate::DATE AS created, o_orderpriority AS priority, o_totalprice AS price, o_custkey AS customer FROM orders)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, strength, outcome): lines as observations of their order."""
    strength = evidence_strength(repeated=F.col("l_quantity") > 10, behavioral=F.col("l_discount") > 0.02, against_baseline=F.col("l_tax") > 0.02, recorded_close=F.col("l_linestatus") == "O", decision_relevant=F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("date"), strength.alias("strength"), F.col("l_returnflag").alias("outcome"))


EVIDENCE = """v AS (SELECT l_orderkey AS id, l_shipdate::DATE AS date, (l_quantity > 10)::INT + (l_discount > 0.02)::INT + (l_tax > 0.02)::INT + (l_linestatus = 'O')::INT + (l_returnflag = 'R')::INT AS strength, l_returnflag AS outcome FROM lineitem)"""
SUPPORT = EVIDENCE + ", s AS (SELECT id, count(*) AS n, count(DISTINCT date) AS n_days, max(strength) AS max_strength FROM v GROUP BY id)"


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, from_state, to_state, at): events as a log; views promote, clicks verify, errors falsify, signups leap."""
    kind = F.col("event_type")
    to = F.when(kind == "view", "active").when(kind == "click", "verified").when(kind == "error", "falsified").when(kind == "purchase", "principle").otherwise("inbox")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when(F.col("value") > 20, "active").otherwise("inbox").alias("from_state"), to.alias("to_state"), F.col("ts").alias("at"))


TRANSITIONS = """t AS (SELECT user_id AS id, CASE WHEN value > 20 THEN 'active' ELSE 'inbox' END AS from_state, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'verified' WHEN 'error' THEN 'falsified' WHEN 'purchase' THEN 'principle' ELSE 'inbox' END AS to_state, ts AS "at" FROM events)"""


def note_id(key: Column, created: Column) -> Column:
    """Identifiers of notes made from orders; every 17th has a prefix that is none."""
    return F.concat(F.when(key % 17 == 0, F.lit("X-")).otherwise(F.lit("A-")), F.date_format(created, "yyyyMMdd"), F.lit("-order-"), key.cast("string"))


NOTE_ID = "(CASE WHEN {k} % 17 = 0 THEN 'X-' ELSE 'A-' END || strftime({d}, '%Y%m%d') || '-order-' || {k})"


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus (path, kind, folder_state, text) with one assumption per order, each with some of the defects that checks look for."""
    c = claims(spark, sf_dir)
    k = F.col("id")
    empty = F.lit(None).cast("string")
    values = {
        "id": note_id(k, F.col("created")),
        "title": F.concat(F.lit("Order: "), F.col("priority")),
        "status": F.when(k % 11 == 0, "verified").otherwise(F.col("state")),
        "domain": F.when(k % 3 == 0, empty).otherwise(F.col("priority")),
        "created_at": day("created"),
        "confidence": F.when(k % 13 == 0, F.lit("1.7")).otherwise(F.lit("0.5")),
        "source": F.when((k > 0) & (k % 4 == 0), F.concat(F.lit("derived from "), note_id(k - 1, F.col("created")))).otherwise(empty),
        "supersedes": empty,
    }
    price = F.floor("price").cast("string")
    sections = {
        "Statement": F.concat(F.lit("- Customer: "), F.col("customer").cast("string"), F.lit("\n- Price: "), price, F.lit("\n  - nested\n-\n")),
        "Why I Believe This": F.concat(F.lit("See [the index](../index.md) and `notes/plan.md`.\n\n| state | price |\n|---|---|\n| "), F.col("state"), F.lit(" | `a|"), price, F.lit("` |")),
        "Decision Relevance": F.when(k % 7 == 0, F.lit("-")).otherwise(F.lit("- moves the next order")),
        "Notes": F.lit("```\n## not a heading\n- not an item\n```\nCreated: 2020-02-02"),
    }
    made = notes.new_note(c, "assumption", values, sections, state=F.col("state"))
    extra = F.when(F.regexp_extract("path", r"order-(\d+)\.md$", 1).cast("long") % 19 == 0, F.lit("\n## Extra Thoughts\n\ntext\n")).otherwise(F.lit(""))
    return made.withColumn("text", F.concat("text", extra))


ORDER_NOTES = CLAIMS + f""", n AS (SELECT id AS k, {NOTE_ID.format(k='id', d='created')} AS id, state, created, priority, floor(price)::BIGINT AS price, customer,
  CASE WHEN id % 11 = 0 THEN 'verified' ELSE state END AS status, CASE WHEN id > 0 AND id % 4 = 0 THEN {NOTE_ID.format(k='(id - 1)', d='created')} END AS derived,
  'assumptions/' || state || '/' || {NOTE_ID.format(k='id', d='created')} || '.md' AS path FROM c)"""
