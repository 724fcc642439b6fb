"""Queries over lifecycles, links, roll-ups, reviews and the cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.functions import costmodel as cost
from trailnote.operators import lifecycle as lc, linkage, ranking, review, rollups, validation as val
from trailnote.plans.bindings import AS_OF, CLAIMS, EVIDENCE, SUPPORT, TRANSITIONS, claims, day, evidence, transitions
from trailnote.plans.pack import Pack
from trailnote.sources.tables import table
from trailnote.sources.templates import MOVES

pack = Pack()
_MOVES = "m(from_state, to_state) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MOVES) + ")"
_LAST = 'l AS (SELECT id, to_state AS state, t."at" AS since FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY t."at" DESC, to_state DESC) = 1)'


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.support(evidence(spark, sf_dir))


# Lifecycle


@pack.add(f"WITH {TRANSITIONS}, {_MOVES} SELECT t.from_state, t.to_state, count(*) AS n FROM t ANTI JOIN m USING (from_state, to_state) GROUP BY ALL")
def lc1_disallowed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.disallowed(transitions(spark, sf_dir)).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


@pack.add(f"WITH {CLAIMS} SELECT id, state FROM c WHERE state = 'inbox' AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def lc2_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("related_assumption"))
    return lc.with_plan(claims(spark, sf_dir).filter("state = 'inbox'"), plans).select("id", "state")


@pack.add(f"WITH {CLAIMS}, {SUPPORT} SELECT c.id, coalesce(n, 0) AS n, coalesce(n, 0) >= 2 AS enough FROM c LEFT JOIN s USING (id) WHERE state = 'active'")
def lc3_enough_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.enough_evidence(claims(spark, sf_dir).filter("state = 'active'"), _support(spark, sf_dir)).select("id", "n", "enough")


_BLOCKS = """concat_ws(', ', CASE WHEN coalesce(n_days, 0) < 2 THEN 'not repeated' END, CASE WHEN NOT relevant THEN 'changes no decision' END, CASE WHEN NOT scope_known THEN 'scope unknown' END, CASE WHEN NOT (coalesce(n, 0) >= 2 OR (coalesce(max_strength, 0) >= 4 AND relevant)) THEN 'one-off' END)"""
_JUDGED = "j AS (SELECT id, 'verified' AS state, price > 100000 AS relevant, id % 5 <> 0 AS scope_known FROM c WHERE state = 'active')"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).filter("state = 'active'").select("id", F.lit("verified").alias("state"), (F.col("price") > 100000).alias("relevant"), (F.col("id") % 5 != 0).alias("scope_known"))


@pack.add(f"WITH {CLAIMS}, {SUPPORT}, {_JUDGED} SELECT id, {_BLOCKS} AS blocked FROM j LEFT JOIN s USING (id)")
def lc4_promotion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = _judged(spark, sf_dir).join(_support(spark, sf_dir), "id", "left")
    why = lc.promotion(F.col("n_days"), F.col("relevant"), F.col("scope_known"), F.col("n"), F.col("max_strength"))
    return met.select("id", F.array_join(why, ", ").alias("blocked"))


@pack.add(f"WITH {CLAIMS}, {SUPPORT} SELECT id, n, n >= 2 OR (max_strength >= 4 AND price > 100000) AS stands FROM c JOIN s USING (id)")
def lc5_single_observation_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = claims(spark, sf_dir).join(_support(spark, sf_dir), "id")
    return met.select("id", "n", lc.outweighs_one_off(F.col("n"), F.col("max_strength"), F.col("price") > 100000).alias("stands"))


@pack.add("""SELECT id, reasons FROM (SELECT o_orderkey AS id, concat_ws(', ', CASE WHEN o_custkey % 10 = 0 THEN 'context changed' END, CASE WHEN o_totalprice > 450000 THEN 'cost went up' END, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'conflicting evidence' END, CASE WHEN o_orderdate < TIMESTAMP '1995-02-01' THEN 'short window' END) AS reasons FROM orders) WHERE reasons <> ''""")
def lc6_recheck_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = lc.recheck_reasons(F.col("o_custkey") % 10 == 0, F.col("o_totalprice") > 450000, (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), F.col("o_orderdate") < F.lit("1995-02-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(why, ", ").alias("reasons")).filter("reasons <> ''")


_SCOPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'always' WHEN '2-HIGH' THEN 'current season' WHEN '3-MEDIUM' THEN 'under constraints' WHEN '5-LOW' THEN 'everywhere' END"


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("created"), F.expr(_SCOPE).alias("validity_scope"))


@pack.add(f"SELECT coalesce(s, '-') AS scope, coalesce(s IN ('always', 'current season', 'under constraints', 'habit / environment'), false) AS valid, coalesce(CASE s WHEN 'always' THEN 1 WHEN 'current season' THEN 2 WHEN 'under constraints' THEN 3 END, 0) AS rank, count(*) AS n FROM (SELECT {_SCOPE} AS s FROM orders) GROUP BY ALL")
def lc7_scope_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.col("validity_scope")
    return _scoped(spark, sf_dir).groupBy(F.coalesce(scope, F.lit("-")).alias("scope"), val.scope_valid(scope).alias("valid"), F.coalesce(val.scope_rank(scope), F.lit(0)).alias("rank")).agg(F.count("*").alias("n"))


@pack.add(f"WITH {EVIDENCE} SELECT strength, count(*) AS n, strength >= 4 AS strong FROM v GROUP BY strength")
def lc8_evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("strength").agg(F.count("*").alias("n")).withColumn("strong", F.col("strength") >= lc.STRONG)


@pack.add(f"WITH {TRANSITIONS}, {_LAST} SELECT id, state, strftime(since, '%Y-%m-%d') AS since FROM l")
def win3_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.current_state(transitions(spark, sf_dir)).select("id", "state", day("since").alias("since"))


@pack.add(f"""WITH {TRANSITIONS}, {_LAST}, {_MOVES}, q AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'active' WHEN c_nationkey % 3 = 1 THEN 'verified' ELSE 'archived' END AS to_state FROM customer),
f AS (SELECT q.id, coalesce(l.state, 'inbox') AS from_state, q.to_state FROM q LEFT JOIN l USING (id)),
p AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 450000), s AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT f.id, f.from_state, f.to_state, coalesce(CASE WHEN m.to_state IS NULL THEN 'no such move' WHEN f.to_state = 'active' AND p.id IS NULL THEN 'no plan' WHEN f.to_state IN ('verified', 'falsified') AND coalesce(n, 0) < 2 THEN 'too little evidence' END, '-') AS refused
FROM f LEFT JOIN m ON m.from_state = f.from_state AND m.to_state = f.to_state LEFT JOIN p ON p.id = f.id LEFT JOIN s ON s.id = f.id""")
def snk2_transition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = F.when(F.col("c_nationkey") % 3 == 0, "active").when(F.col("c_nationkey") % 3 == 1, "verified").otherwise("archived")
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), to.alias("to_state"), F.lit(AS_OF).cast("timestamp").alias("at"))
    orders = table(spark, sf_dir, "orders")
    plans = orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("related_assumption"))
    backing = orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    done = lc.requested(lc.current_state(transitions(spark, sf_dir)), requests, plans, backing)
    return done.select("id", "from_state", "to_state", F.coalesce("refused", F.lit("-")).alias("refused"))


# Joins


@pack.add("""WITH a AS (SELECT DISTINCT o_orderkey AS a, o_orderkey % 1000 AS b FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT l_orderkey AS a, l_orderkey % 1000 AS b FROM lineitem)
SELECT coalesce(a.a, b.a) AS a, coalesce(a.b, b.b) AS b, CASE WHEN b.a IS NULL THEN 'first only' WHEN a.a IS NULL THEN 'second only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.a = b.a AND a.b = b.b""")
def j1_one_sided_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b"))
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") % 1000).alias("b"))
    return linkage.one_sided(left, right)


@pack.add(f"WITH {CLAIMS}, {EVIDENCE} SELECT state, outcome, count(*) AS n, count(*) FILTER (date >= created) AS after_claim FROM v JOIN c USING (id) GROUP BY ALL")
def j2_evidence_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = evidence(spark, sf_dir).join(claims(spark, sf_dir), "id")
    return met.groupBy("state", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("date") >= F.col("created")).alias("after_claim"))


@pack.add("SELECT p_brand AS brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def j3_evidence_of_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@pack.add("SELECT s_suppkey AS id, unnest(['A-' || s_suppkey, 'A-' || (s_suppkey + 1)]) AS source FROM supplier UNION ALL SELECT s_suppkey, 'EV-' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def j4_derived_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    told = F.concat_ws(", ", F.concat(F.lit("A-"), key.cast("string")), F.concat(F.lit("A-"), (key + 1).cast("string")), F.when(key % 2 == 0, F.concat(F.lit("EV-"), F.col("s_nationkey").cast("string"))))
    return linkage.derived_pairs(table(spark, sf_dir, "supplier").select(key.alias("id"), told.alias("derived_from")))


@pack.add("""WITH RECURSIVE e AS (SELECT o_orderkey AS id, o_orderkey // d AS source FROM orders, (VALUES (2), (3)) t(d) WHERE o_orderkey // d > 0 AND o_orderkey // d <> o_orderkey AND o_orderkey // d IN (SELECT o_orderkey FROM orders)),
up(id, other) AS (SELECT id, source FROM e UNION SELECT up.id, e.source FROM up JOIN e ON e.id = up.other), mine AS (SELECT id, other FROM up UNION SELECT o_orderkey, o_orderkey FROM orders)
SELECT mine.id, count(DISTINCT l_partkey) AS support FROM mine LEFT JOIN lineitem ON l_orderkey = mine.other GROUP BY mine.id""")
def j4_lineage_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order stands on those with half and a third of its number, and these on others: how many distinct parts support it through all of them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    links = orders.select("id", F.explode(F.array(F.expr("id div 2"), F.expr("id div 3"))).alias("source")).filter("source > 0 AND source <> id")
    links = links.join(orders.select(F.col("id").alias("source")), "source", "left_semi")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item"))
    return linkage.lineage_support(links, orders.join(items, "id", "left")).select("id", "support")


@pack.add("""WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 2 WHEN c_custkey % 50 = 3 THEN c_custkey - 2 WHEN c_custkey % 50 > 10 THEN c_custkey - 1 END AS supersedes FROM customer),
nodes AS (SELECT id FROM e UNION SELECT supersedes FROM e WHERE supersedes IS NOT NULL), n AS (SELECT supersedes AS id, min(id) AS next FROM e WHERE supersedes IS NOT NULL GROUP BY 1),
w(id, cur, hops) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT w.id, n.next, hops + 1 FROM w JOIN n ON n.id = w.cur WHERE hops < 60),
t AS (SELECT w.id, w.cur, w.hops FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = w.cur))
SELECT nodes.id, coalesce(t.cur, -1)::BIGINT AS latest, coalesce(t.hops, -1)::BIGINT AS hops, t.id IS NULL AS cyclic FROM nodes LEFT JOIN t USING (id)""")
def j5_supersedes_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 40 and cycles of 2."""
    key = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 50 == 1, key + 2).when(key % 50 == 3, key - 2).when(key % 50 > 10, key - 1).alias("supersedes"))
    return linkage.chain_ends(edges).select("id", F.coalesce("latest", F.lit(-1)).cast("long").alias("latest"), F.coalesce("hops", F.lit(-1)).cast("long").alias("hops"), "cyclic")


_SEASONS = ("SELECT s::DATE AS start, CASE WHEN month(s) <> 7 THEN (s + INTERVAL 5 MONTH)::DATE END AS \"end\", 'season ' || strftime(s, '%Y-%m') AS season FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-01', INTERVAL 6 MONTH)) AS s)")


@pack.add(f"""WITH {CLAIMS}, p AS ({_SEASONS}) SELECT id, coalesce(CASE WHEN "end" IS NULL OR created < "end" THEN season END, '-') AS season FROM c ASOF LEFT JOIN p ON c.created >= p.start""")
def j8_season_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-years as seasons; those from January end after five months, those from July stay open."""
    start = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-07-01").cast("date"), F.expr("INTERVAL 6 MONTH")))
    seasons = spark.range(1).select(start.alias("start"))
    seasons = seasons.select("start", F.when(F.month("start") != 7, F.add_months("start", 5)).alias("end"), F.concat(F.lit("season "), F.date_format("start", "yyyy-MM")).alias("season"))
    return linkage.in_period(claims(spark, sf_dir).select("id", "created"), seasons, "created").select("id", F.coalesce("season", F.lit("-")).alias("season"))


@pack.add("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j10_plan_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("related_assumption"))
    return lc.with_plan(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), plans)


# Aggregations


@pack.add(f"WITH {CLAIMS} SELECT coalesce(priority, 'all') AS kind, coalesce(state, 'all') AS state, count(*) AS n, grouping_id(priority, state)::INT AS level FROM c GROUP BY ROLLUP (priority, state)")
def agg1_lifecycle_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.funnel(claims(spark, sf_dir), "priority", "state")
    return rows.select(F.coalesce("priority", F.lit("all")).alias("kind"), F.coalesce("state", F.lit("all")).alias("state"), "n", "level")


@pack.add(f"WITH {SUPPORT} SELECT * FROM s")
def agg2_evidence_per_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.evidence_per(evidence(spark, sf_dir), "id", "date", "strength")


@pack.add("SELECT l_returnflag AS flag, count(*) AS n, round(avg(CASE WHEN l_linenumber < 6 THEN l_discount - l_tax END), 4) AS mean_delta FROM lineitem GROUP BY 1")
def agg3_confidence_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_tax").alias("before"), F.when(F.col("l_linenumber") < 6, F.col("l_discount")).alias("after"))
    return rollups.confidence_delta(rows, "before", "after", "flag")


_SESSIONS = "s AS (SELECT ts::DATE AS day, CASE event_type WHEN 'view' THEN 'main' WHEN 'click' THEN 'second' WHEN 'purchase' THEN 'third' ELSE 'free' END AS focus, (value % 50)::BIGINT AS minutes, (user_id % 4)::BIGINT AS bullets, CASE event_type WHEN 'view' THEN 'promoted' WHEN 'click' THEN 'parked' WHEN 'error' THEN 'deleted' ELSE 'kept' END AS action, user_id FROM events)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    focus = F.when(kind == "view", "main").when(kind == "click", "second").when(kind == "purchase", "third").otherwise("free")
    action = F.when(kind == "view", "promoted").when(kind == "click", "parked").when(kind == "error", "deleted").otherwise("kept")
    # Rounded as the oracle's cast rounds.
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), focus.alias("focus"), F.bround(F.col("value") % 50).cast("long").alias("minutes"), (F.col("user_id") % 4).alias("bullets"), action.alias("action"), "user_id")


@pack.add(f"""WITH {_SESSIONS}, d AS (SELECT strftime(day, '%Y-%m-%d') || '/' || (user_id % 20) AS day, coalesce(sum(minutes) FILTER (focus IN ('main', 'second')), 0)::BIGINT AS read, coalesce(sum(minutes) FILTER (focus = 'third'), 0)::BIGINT AS write,
  coalesce(sum(minutes) FILTER (focus = 'free'), 0)::BIGINT AS follow_up, sum(bullets)::BIGINT AS bullets FROM s GROUP BY 1) SELECT *, CASE WHEN read >= 45 AND write >= 10 AND follow_up >= 5 THEN 'full' WHEN read >= 20 AND bullets >= 3 THEN 'minimum' ELSE 'missed' END AS met FROM d""")
def agg4_daily_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("focus").isin("main", "second"), "read").when(F.col("focus") == "third", "write").otherwise("follow up")
    rows = _sessions(spark, sf_dir).withColumns({"day": F.concat_ws("/", day("day"), (F.col("user_id") % 20).cast("string")), "part": part})
    return rollups.daily_contract(rows, "day", "part", "minutes", "bullets")


_PLAN = tuple(zip(("main", "second", "third", "free"), rollups.WEEKLY_DAYS))


@pack.add(f"""WITH {_SESSIONS}, p(focus, planned) AS (VALUES {", ".join(f"('{f}', {n})" for f, n in _PLAN)}), w AS (SELECT date_trunc('week', day)::DATE AS week, focus, count(DISTINCT day) AS days FROM s GROUP BY ALL)
SELECT strftime(week, '%Y-%m-%d') AS week, focus, days, planned, days >= planned AS on_plan FROM w JOIN p USING (focus)""")
def agg5_weekly_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.createDataFrame(list(_PLAN), "focus string, planned int")
    return rollups.weekly_mix(_sessions(spark, sf_dir), "day", "focus", plan).withColumn("week", day("week"))


@pack.add(f"WITH {CLAIMS} SELECT strftime(DATE '1970-01-05' + INTERVAL (((created - DATE '1970-01-05') // 28) * 28) DAY, '%Y-%m-%d') AS period, count(*) AS n, count(*) >= 20 AS reached FROM c GROUP BY 1")
def agg6_notes_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.notes_target(claims(spark, sf_dir), "created").withColumn("period", day("period"))


@pack.add(f"WITH {_SESSIONS} SELECT count(*) FILTER (action = 'promoted') AS promoted, count(*) FILTER (action = 'parked') AS parked, count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action IN ('parked', 'deleted')) > count(*) FILTER (action = 'promoted') AS healthy FROM s")
def agg7_pool_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.pool_pressure(_sessions(spark, sf_dir))


@pack.add(f"WITH {_SESSIONS} SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS promoted, count(*) <= 2 AS within FROM s WHERE action = 'promoted' GROUP BY 1")
def agg8_promotion_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.promotion_cap(_sessions(spark, sf_dir), "day").withColumn("week", day("week"))


@pack.add(f"""WITH {TRANSITIONS} SELECT strftime(t."at", '%Y-%m') AS period, count(*) FILTER (to_state IN ('active', 'verified', 'principle')) AS advanced, count(*) FILTER (to_state = 'falsified') AS invalidated, count(*) FILTER (to_state = 'inbox') AS other FROM t GROUP BY 1""")
def agg9_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.per_period(transitions(spark, sf_dir), F.date_format("at", "yyyy-MM"))


# Order, top-k, sets


@pack.add(f"WITH {CLAIMS} SELECT id, strftime(created, '%Y-%m-%d') AS due, (created - DATE '{AS_OF}')::INT AS days_left FROM c ORDER BY created, id LIMIT 20")
def win4_review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.review_due(claims(spark, sf_dir), F.lit(AS_OF).cast("date"), "id", "created", 20).select("id", day("created").alias("due"), "days_left")


@pack.add("SELECT r_name AS value, row_number() OVER (ORDER BY length(r_name) DESC, r_name)::INT AS rank FROM region")
def top1_value_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "region").select(F.col("r_name").alias("value")), F.desc(F.length("value")), "value")


@pack.add("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 25")
def top2_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.by_priority(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 25)


@pack.add("SELECT o_orderkey, o_custkey, row_number() OVER w::INT AS place, row_number() OVER w > 3 AS excess FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def top3_at_most_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ranking.at_most(rows, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@pack.add("SELECT p_brand AS item FROM part WHERE p_size < 30 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 998 AND p_size = 50 EXCEPT SELECT 'Brand#1'")
def set3_pool_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    item = F.col("p_brand").alias("item")
    return ranking.pool_left(part.filter("p_size < 30").select(item), part.filter("p_retailprice > 998 AND p_size = 50").select(item), spark.range(1).select(F.lit("Brand#1").alias("item")))


# Cost model

_SHAPE = "p_size AS b, p_partkey % 512 + 1 AS d, p_size * 4 AS f"


@pack.add(f"""WITH p AS (SELECT p_partkey, {_SHAPE} FROM part), m AS (SELECT p_partkey, 2.0::DOUBLE * b * d * f AS flops, 2.0::DOUBLE * (b * d + d * f + b * f) AS bytes FROM p)
SELECT p_partkey, flops, bytes, round(flops / bytes, 6) AS intensity, CASE WHEN flops / bytes > 200e12 / 8e11 THEN 'compute' ELSE 'bandwidth' END AS bound FROM m""")
def math1_4_matmul_roofline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d, f = (F.col(x) for x in "bdf")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("b"), (F.col("p_partkey") % 512 + 1).alias("d"), (F.col("p_size") * 4).cast("long").alias("f"))
    rows = rows.select("p_partkey", cost.matmul_flops(b, d, f).alias("flops"), cost.matmul_bytes(b, d, f).alias("bytes"))
    reached = cost.arithmetic_intensity(F.col("flops"), F.col("bytes"))
    return rows.select("p_partkey", "flops", "bytes", F.round(reached, 6).alias("intensity"), cost.bound_by(reached, cost.critical_intensity(F.lit(200e12), F.lit(8e11))).alias("bound"))


@pack.add("SELECT s_suppkey, round(1e12 * (s_suppkey + 1) / (1e9 * (s_nationkey + 1)), 4) AS critical FROM supplier")
def math2_critical_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(cost.critical_intensity(F.lit(1e12) * (F.col("s_suppkey") + 1), F.lit(1e9) * (F.col("s_nationkey") + 1)), 4).alias("critical"))


@pack.add("SELECT c_custkey, round((c_custkey + 1) * 128 / nullif(c_nationkey, 0)::DOUBLE, 6) AS tokens FROM customer")
def math5_local_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(cost.local_batch(F.col("c_custkey") + 1, F.lit(128), F.col("c_nationkey")), 6).alias("tokens"))


# Review questions


@pack.add(f"WITH {CLAIMS}, {EVIDENCE} SELECT id, state FROM c WHERE state = 'active' AND id NOT IN (SELECT id FROM v WHERE date > DATE '{AS_OF}' - 30 AND date <= DATE '{AS_OF}')")
def rq1_without_recent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.without_recent_evidence(claims(spark, sf_dir), evidence(spark, sf_dir), F.lit(AS_OF).cast("date"))


@pack.add(f"WITH {CLAIMS}, {SUPPORT}, {_JUDGED} SELECT id, coalesce(n, 0) AS n, coalesce(n_days, 0) AS n_days, {_BLOCKS} AS blocked FROM j LEFT JOIN s USING (id) WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def rq2_ready_for_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("source"))
    return review.ready_for_promotion(_judged(spark, sf_dir), _support(spark, sf_dir), derived).withColumn("blocked", F.array_join("blocked", ", "))


@pack.add(f"WITH {SUPPORT} SELECT o_orderkey AS id, coalesce(n, 0) AS n FROM orders LEFT JOIN s ON s.id = o_orderkey WHERE {_SCOPE} = 'always' AND coalesce(n, 0) < 3")
def rq3_too_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.too_broad(_scoped(spark, sf_dir), _support(spark, sf_dir))


@pack.add(f"SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS recheck_at, CASE WHEN o_custkey % 10 = 0 THEN 'context changed' ELSE '' END AS reasons FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}' OR o_custkey % 10 = 0")
def rq4_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("recheck_at"), lc.recheck_reasons(F.col("o_custkey") % 10 == 0, no, no, no).alias("reasons"))
    return review.stale(rows, F.lit(AS_OF).cast("date")).select("id", day("recheck_at").alias("recheck_at"), F.array_join("reasons", ", ").alias("reasons"))


@pack.add(f"WITH {SUPPORT} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM v)")
def rq3_unsupported_principles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unsupported(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), evidence(spark, sf_dir))


@pack.add(f"""WITH {_SESSIONS} SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS sessions, sum(minutes)::BIGINT AS minutes, count(*) FILTER (action <> 'kept') AS changed, count(*) FILTER (action = 'promoted') AS promoted, count(*) FILTER (action = 'parked') AS parked, count(*) FILTER (action = 'deleted') AS deleted,
  count(*) FILTER (focus = 'main') AS assumption, count(*) FILTER (focus = 'second') AS experiment, count(*) FILTER (focus = 'third') AS principle, greatest(0, 2 - count(*) FILTER (action = 'promoted'))::BIGINT AS room FROM s GROUP BY 1""")
def rq5_weekly_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir)
    kind = F.when(F.col("focus") == "main", "assumption").when(F.col("focus") == "second", "experiment").when(F.col("focus") == "third", "principle")
    return review.weekly_questions(rows, rows.filter("action <> 'kept'"), rows, rows.select("day", kind.alias("kind")), "day").withColumn("week", day("week"))


@pack.add(f"""WITH {_SESSIONS}, w AS (SELECT date_trunc('week', day) AS week, greatest(0, 2 - count(*) FILTER (action = 'promoted' AND day(day) = 1)) AS room FROM s GROUP BY 1),
i AS (SELECT p_brand AS item, min(p_retailprice) AS rank FROM part WHERE p_size < 30 GROUP BY 1), c AS (SELECT * FROM i WHERE item NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 998 AND p_size = 50) AND item <> 'Brand#1'),
r AS (SELECT item, row_number() OVER (ORDER BY rank, item) AS place FROM c) SELECT strftime(week, '%Y-%m-%d') AS week, place, item FROM w JOIN r ON place <= least(room, 2)""")
def rq5_pool_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands recommended by price that are neither in use nor parked, for the room that each week's promotions leave; only those on the first of a month count."""
    rows, part = _sessions(spark, sf_dir), table(spark, sf_dir, "part")
    kept = rows.filter("action = 'kept'").select("day", F.lit(None).cast("string").alias("kind"))
    weeks = review.weekly_questions(rows, rows.filter("action <> 'kept'"), rows.filter(F.dayofmonth("day") == 1), kept, "day").select(day("week").alias("week"), "room")
    item = F.col("p_brand").alias("item")
    recommended = part.filter("p_size < 30").select(item, F.col("p_retailprice").alias("rank"))
    return review.pool_moves(weeks, recommended, part.filter("p_retailprice > 998 AND p_size = 50").select(item), spark.range(1).select(F.lit("Brand#1").alias("item")))


@pack.add(f"SELECT o_orderkey AS id FROM orders WHERE (o_orderpriority <> '5-LOW' AND o_orderdate <= TIMESTAMP '{AS_OF}') OR o_orderstatus = 'P'")
def rq6_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.to_date("o_orderdate")).alias("revisit_at"), (F.col("o_orderstatus") == "P").alias("triggered"))
    return review.reopened(rows, F.lit(AS_OF).cast("date")).select("id")


@pack.add(f"WITH {CLAIMS}, {EVIDENCE} SELECT 'no recent evidence' AS query, id::VARCHAR AS id FROM c WHERE state = 'active' AND id NOT IN (SELECT id FROM v WHERE date > DATE '{AS_OF}' - 30 AND date <= DATE '{AS_OF}') UNION ALL SELECT 'unsupported', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT id FROM v)")
def rq_periodic_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("date")
    parts = {"no recent evidence": rq1_without_recent_evidence(spark, sf_dir), "unsupported": rq3_unsupported_principles(spark, sf_dir)}
    return review.findings(as_of, **parts).select("query", "id")
