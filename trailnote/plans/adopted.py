"""General analytics over the star schema, files and streams: Spark's own operators, adopted for completeness."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailnote.plans.bindings import day
from trailnote.plans.pack import Pack
from trailnote.sources.tables import new_folder, table
from trailnote.streaming import trails

pack = Pack()
_REV = "l_extendedprice * (1 - l_discount)"


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@pack.add(f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REV}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def a_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@pack.add(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, round(sum({_REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1999-03-15' AND l_shipdate > TIMESTAMP '1999-03-15' GROUP BY 1, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10")
def a_shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("1999-03-15").cast("timestamp_ntz")
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < cut)
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > cut)
    met = rows.join(o.join(c, F.col("c_custkey") == F.col("o_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(_revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10).withColumn("o_orderdate", day("o_orderdate"))


@pack.add(f"SELECT n_name, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def a_local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    places = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sold = t("lineitem").join(t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return sold.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@pack.add("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@pack.add("SELECT coalesce(p_brand, '-') AS brand, coalesce(p_type, '-') AS type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def a_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("p_brand", F.lit("-")).alias("brand"), F.coalesce("p_type", F.lit("-")).alias("type"), "n")


@pack.add("""SELECT o_orderkey, rank() OVER w::INT AS r, dense_rank() OVER w::INT AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS quarter, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS cume FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def a_rank_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("cume"))


@pack.add("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(o_orderdate) RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS in_90_days, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders""")
def a_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("last_three"), F.count("*").over(by.orderBy(seconds).rangeBetween(-7776000, 0)).alias("in_90_days"), F.first("o_orderkey").over(by.orderBy("o_orderdate", "o_orderkey")).alias("first_order"))


@pack.add("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def a_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@pack.add("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def a_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@pack.add("SELECT coalesce(c_custkey, -1) AS c, coalesce(s_suppkey, -1) AS s FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON c_custkey = s_suppkey * 3")
def a_full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").join(table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), F.col("c_custkey") == F.col("s_suppkey") * 3, "full")
    return met.select(F.coalesce("c_custkey", F.lit(-1)).alias("c"), F.coalesce("s_suppkey", F.lit(-1)).alias("s"))


@pack.add("SELECT user_id, event_id, coalesce(paid, -1) AS paid FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id AS u, ts AS t, max(event_id) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.u AND e.ts >= p.t")
def a_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before each error of the same user."""
    from trailnote.operators import linkage

    events = table(spark, sf_dir, "events")
    paid = events.filter("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("start")).agg(F.max("event_id").alias("paid"))
    met = linkage.as_of(events.filter("event_type = 'error'").select("user_id", "event_id", "ts"), paid, "ts", keys=("user_id",))
    return met.select("user_id", "event_id", F.coalesce("paid", F.lit(-1)).alias("paid"))


@pack.add("SELECT (props::JSON ->> 'k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def a_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.from_json("props", "k long")["k"] % 10).alias("k")).agg(F.count("*").alias("n"))


@pack.add("SELECT vec_id, len(embedding)::INT AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def a_array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(F.sqrt(squares), 4).alias("norm"))


@pack.add("SELECT lang, count(*) AS n, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')))::BIGINT AS words, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY lang")
def a_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.when(F.col("text").isNotNull(), words), F.lit(0))).cast("long").alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@pack.add("SELECT count(DISTINCT l_partkey) AS parts, true AS parts_within, quantile_cont(l_quantity, 0.5) AS median, true AS median_within FROM lineitem")
def a_approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact numbers, and whether the sketches hold their bounds: five standard errors of the count, one unit of the median.

    Beside a distinct count Spark keeps every other aggregate of its step for each distinct value, so sketches, distinct
    count and median are aggregates of their own; the median is taken over counted quantities.
    """
    rows = table(spark, sf_dir, "lineitem")
    sketches = rows.agg(F.approx_count_distinct("l_partkey", 0.02).alias("near_parts"), F.percentile_approx("l_quantity", 0.5, 10000).alias("near_median"))
    parts = rows.agg(F.count_distinct("l_partkey").alias("parts"))
    median = rows.groupBy("l_quantity").agg(F.count("*").alias("n")).agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("median"))
    told = sketches.crossJoin(parts).crossJoin(median)
    return told.select("parts", (F.abs(F.col("near_parts") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_within"), "median", (F.abs(F.col("near_median") - F.col("median")) <= 1).alias("median_within"))


@pack.add("SELECT o_orderpriority, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0)::DECIMAL(18, 2)::DOUBLE AS open, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0)::DECIMAL(18, 2)::DOUBLE AS done FROM orders GROUP BY 1")
def a_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["O", "F"]).agg(F.sum("o_totalprice"))
    return wide.select("o_orderpriority", F.round(F.coalesce("O", F.lit(0.0)), 2).alias("open"), F.round(F.coalesce("F", F.lit(0.0)), 2).alias("done"))


@pack.add("SELECT s_suppkey, measure, round(value, 2) AS value FROM (UNPIVOT (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS place FROM supplier) ON s_acctbal, place INTO NAME measure VALUE value)")
def a_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("place"))
    return rows.unpivot("s_suppkey", ["s_acctbal", "place"], "measure", "value").withColumn("value", F.round("value", 2))


def _through(fmt: str, **options):
    """Orders written in a format and read back with the schema they had."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_folder(spark, fmt)
        rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", day("o_orderdate").alias("day"))
        rows.write.format(fmt).options(**options).save(path)
        back = spark.read.format(fmt).schema(rows.schema).options(**options).load(path)
        return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("day").alias("last"))

    query.__name__ = f"a_{fmt}_round_trip"
    return query


for _fmt, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
    pack.add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1")(_through(_fmt, **_options))


# Streams


SLICES = 4


def _told(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame], closing: bool = True) -> DataFrame:
    """What a stream made of events tells, by way of Parquet files in the shared folder.

    Events arrive in SLICES slices of time; each is a run of its own that goes on from the state of
    the one before. With closing, a row 60 days later then moves the watermark past all that is open.
    """
    events = table(spark, sf_dir, "events")
    arriving, out = new_folder(spark, "arriving"), new_folder(spark, "stream")
    at = F.col("ts").cast("timestamp").cast("long")
    first, last = events.agg(F.coalesce(F.min(at), F.lit(0)), F.coalesce(F.max(at), F.lit(0))).first()
    closer = [F.timestamp_seconds(F.lit(last + 60 * 86400)) if f.name == "ts" else F.lit(None) for f in events.schema]
    closer = spark.range(1).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(closer, events.schema)])
    slices = [events.filter(F.floor((at - first) * SLICES / (last - first + 1)) == i) for i in range(SLICES)]
    stream = None
    for part in slices + [closer] * closing:
        part.write.mode("append").parquet(arriving)
        stream = made(trails.event_stream(spark, arriving, events.schema))
        trails.run_to_files(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


@pack.add("""SELECT a.user_id, a.event_id AS start_id, b.event_id FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 DAYS WHERE a.event_type = 'signup' AND b.event_type = 'purchase'""")
def stream_evidence_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups and the purchases within three days of them, from two streams of the arriving events."""

    def made(events: DataFrame) -> DataFrame:
        starts = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("ts").alias("started"))
        return trails.met_in_time(starts, events.filter("event_type = 'purchase'"), "user_id")

    return _told(spark, sf_dir, made).select("user_id", "start_id", "event_id")


@pack.add("""SELECT DISTINCT a.user_id AS loop, strftime(a.ts, '%Y-%m-%d %H:%M') AS offloaded, strftime(a.ts + INTERVAL 18 HOURS, '%Y-%m-%d %H:%M') AS reopened FROM events a
WHERE a.event_type = 'view' AND NOT EXISTS (FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 18 HOURS)""")
def stream_reopened_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view puts a user's loop away for 18 hours; it is reopened by a timer if nothing of the user comes until then."""
    until = F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 18 HOURS"))
    told = _told(spark, sf_dir, lambda events: trails.reopened(events.select(F.col("user_id").alias("loop"), "ts", until.alias("until"))))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return told.select("loop", stamp("offloaded"), stamp("reopened"))


@pack.add("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir, trails.windowed_counts)
    return rows.select(day("start").alias("day"), "event_type", "n", "total")


@pack.add("SELECT strftime(date_trunc('day', ts) - INTERVAL (k) DAY, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) o(k) GROUP BY 1, 2")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir, partial(trails.windowed_counts, width="2 days", slide="1 day"))
    return rows.select(day("start").alias("day"), "event_type", "n", "total")


@pack.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir, trails.sessions)
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@pack.add("WITH t AS (SELECT user_id, event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events) SELECT state, next_state, count(*) AS n FROM t WHERE next_state IS NOT NULL GROUP BY ALL")
def stream_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _told(spark, sf_dir, trails.transitions, closing=False).filter("n_late = 0")
    return rows.groupBy("state", "next_state").agg(F.count("*").alias("n"))


# Further built-ins and the SQL surface


@pack.add("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON floor(o_totalprice)::BIGINT >= s_suppkey * 1000 AND floor(o_totalprice)::BIGINT < s_suppkey * 1000 + 700")
def a_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailnote.operators import linkage

    points = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"))
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 1000).alias("lo"), (F.col("s_suppkey") * 1000 + 700).alias("hi"))
    return linkage.within(points, bands, "price", "lo", "hi", 1000).select("o_orderkey", "s_suppkey")


@pack.add("SELECT c_custkey, upper(c_name) AS upper, substr(c_name, 10, 4) AS part, replace(c_mktsegment, 'U', 'v') AS replaced, lpad(c_nationkey::VARCHAR, 3, '0') AS padded, length(c_mktsegment)::INT AS size, md5(c_name) AS digest, concat_ws('-', c_mktsegment, c_nationkey) AS joined, reverse(c_mktsegment) AS back, regexp_replace(c_name, '0+', '0') AS squeezed FROM customer")
def a_string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(name).alias("upper"), F.substring(name, 10, 4).alias("part"), F.replace(segment, F.lit("U"), F.lit("v")).alias("replaced"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("padded"), F.length(segment).alias("size"), F.md5(name).alias("digest"), F.concat_ws("-", segment, "c_nationkey").alias("joined"), F.reverse(segment).alias("back"), F.regexp_replace(name, "^([^0]*)0+", "$10").alias("squeezed"))


@pack.add("SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, dayofweek(o_orderdate)::INT + 1 AS dow, strftime(last_day(o_orderdate::DATE), '%Y-%m-%d') AS month_end, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS later, (DATE '2002-01-01' - o_orderdate::DATE)::INT AS age FROM orders")
def a_date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(at).alias("y"), F.quarter(at).alias("q"), F.dayofweek(at).alias("dow"), day(F.last_day(at)).alias("month_end"), day(F.add_months(at.cast("date"), 3)).alias("later"), F.datediff(F.lit("2002-01-01").cast("date"), at.cast("date")).alias("age"))


_SQL_TOP = "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5) SELECT c_custkey, n, round(total, 2) AS total FROM spent JOIN customer ON c_custkey = o_custkey WHERE total > (SELECT avg(total) FROM spent) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)"


@pack.add(_SQL_TOP)
def a_sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text in both engines: common tables, a scalar and a correlated subquery."""
    return spark.sql(_SQL_TOP.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("FROM nation", "FROM {nation}"), **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")})


_SQL_DEPTH = "WITH RECURSIVE up(id, top, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM {s} UNION ALL SELECT id, CAST(floor(top / 2) AS BIGINT), depth + 1 FROM up WHERE top > 0 AND depth < 40) SELECT id, max(depth) AS depth FROM up GROUP BY id"


@pack.add(_SQL_DEPTH.format(s="supplier"))
def a_sql_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SQL_DEPTH, s=table(spark, sf_dir, "supplier"))


@pack.add("SELECT event_type, round(sum(value * w) / sum(w), 6) AS weighted FROM (SELECT event_type, value, 1 + event_id % 3 AS w FROM events) GROUP BY 1")
def a_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user aggregate would do, as two built-in sums that combine before the shuffle."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", (1 + F.col("event_id") % 3).alias("w"))
    return rows.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 6).alias("weighted"))


@pack.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, round(stddev_samp(value), 4) AS spread, mode(CASE WHEN value > 20 THEN 'high' ELSE 'low' END ORDER BY 1) IS NOT NULL AS has_mode FROM events GROUP BY user_id")
def a_collecting_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.round(F.stddev_samp("value"), 4).alias("spread"), F.mode(F.when(F.col("value") > 20, "high").otherwise("low")).isNotNull().alias("has_mode"))
