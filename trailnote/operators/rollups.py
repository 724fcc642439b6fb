"""Aggregations over notes, sessions and logs. Each is one grouped aggregate whose partial results are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes of a full day's parts and of the least that still counts (ours where the text gives none).
# Minutes of a full day by part, and the least of an overloaded one.
FULL_MINUTES = {"read": 45, "write": 10, "follow up": 5}
MINIMUM_MINUTES, MINIMUM_BULLETS = 20, 3
NOTES_TARGET = 20
WEEKLY_PROMOTIONS = 2
# Planned days a week by focus, first to fourth.
WEEKLY_DAYS = (4, 1, 1, 1)


def week_of(day: Column) -> Column:
    """The Monday of a day's week, as a date."""
    return F.date_trunc("week", day).cast("date")


def funnel(notes: DataFrame, kind: str = "kind", state: str = "state") -> DataFrame:
    """(kind, state, n, level): counts by kind and state with totals; level 0 is a pair, 1 a kind's total, 3 all."""
    return notes.rollup(kind, state).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def evidence_per(evidence: DataFrame, key: str, day: str, strength: str) -> DataFrame:
    """(key, n, n_days, max_strength)."""
    return evidence.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(day).alias("n_days"), F.max(strength).alias("max_strength"))


def confidence_delta(experiments: DataFrame, before: str, after: str, by: str) -> DataFrame:
    """(by, n, mean_delta): rows that lack either value do not count in the mean."""
    return experiments.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(after) - F.col(before)), 4).alias("mean_delta"))


def daily_contract(sessions: DataFrame, day: str, part: str, minutes: str, bullets: str) -> DataFrame:
    """(day, read, write, follow_up, bullets, met): full if every part has its minutes, minimum if enough was read and noted, else missed. Unknown parts do not count."""
    spent = lambda x: F.coalesce(F.sum(F.when(F.col(part) == x, F.col(minutes))), F.lit(0)).cast("long").alias(x.replace(" ", "_"))
    per = sessions.groupBy(F.col(day).alias("day")).agg(*map(spent, FULL_MINUTES), F.coalesce(F.sum(bullets), F.lit(0)).cast("long").alias("bullets"))
    full = F.lit(True)
    for x, least in FULL_MINUTES.items():
        full = full & (F.col(x.replace(" ", "_")) >= least)
    return per.withColumn("met", F.when(full, "full").when((F.col("read") >= MINIMUM_MINUTES) & (F.col("bullets") >= MINIMUM_BULLETS), "minimum").otherwise("missed"))


def weekly_mix(sessions: DataFrame, day: str, focus: str, plan: DataFrame) -> DataFrame:
    """(week, focus, days, planned, on_plan): distinct days of each week's foci against plan (focus, planned)."""
    per = sessions.groupBy(week_of(F.col(day)).alias("week"), F.col(focus).alias("focus")).agg(F.count_distinct(F.to_date(day)).alias("days"))
    # The plan has one row per focus.
    met = per.join(F.broadcast(plan.select("focus", "planned")), "focus", "left")
    return met.select("week", "focus", "days", "planned", (F.col("days") >= F.coalesce("planned", F.lit(0))).alias("on_plan"))


def notes_target(notes: DataFrame, day: str, weeks: int = 4, least: int = NOTES_TARGET) -> DataFrame:
    """(period, n, reached): short notes per window of so many weeks from 1970-01-05 on."""
    start = F.window(F.col(day).cast("timestamp"), f"{weeks} weeks", startTime="4 days")["start"].cast("date")
    return notes.groupBy(start.alias("period")).agg(F.count("*").alias("n")).withColumn("reached", F.col("n") >= least)


def pool_pressure(moves: DataFrame, action: str = "action") -> DataFrame:
    """One row: promoted, parked, deleted, and whether more went than was promoted."""
    one = moves.agg(*[F.count_if(F.col(action) == x).alias(x) for x in ("promoted", "parked", "deleted")])
    return one.withColumn("healthy", F.col("parked") + F.col("deleted") > F.col("promoted"))


def promotion_cap(moves: DataFrame, day: str, action: str = "action", most: int = WEEKLY_PROMOTIONS) -> DataFrame:
    """(week, promoted, within)."""
    per = moves.filter(F.col(action) == "promoted").groupBy(week_of(F.col(day)).alias("week")).agg(F.count("*").alias("promoted"))
    return per.withColumn("within", F.col("promoted") <= most)


def per_period(transitions: DataFrame, period: Column) -> DataFrame:
    """(period, advanced, invalidated, other): moves of each period."""
    up, down = F.col("to_state").isin("active", "verified", "principle"), F.col("to_state") == "falsified"
    return transitions.groupBy(period.alias("period")).agg(F.count_if(up).alias("advanced"), F.count_if(down).alias("invalidated"), F.count_if(~up & ~down).alias("other"))
