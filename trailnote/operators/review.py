"""Review questions: compositions that a periodic review asks. as_of is a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailnote.operators import lifecycle, ranking, rollups

#: Days within which evidence is recent; observations under which a scope of "always" is too broad.
RECENT_DAYS, BROAD_BELOW = 30, 3


def without_recent_evidence(current: DataFrame, evidence: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """(id, state): active ids with no evidence (id, date) in the days up to as_of."""
    recent = evidence.filter((F.col("date") > F.date_sub(as_of, days)) & (F.col("date") <= as_of)).select("id").distinct()
    return current.filter("state = 'active'").join(recent, "id", "left_anti").select("id", "state")


def ready_for_promotion(notes: DataFrame, support: DataFrame, derived: DataFrame) -> DataFrame:
    """(id, n, n_days, blocked): verified notes (id, state, relevant, scope_known) from which nothing is derived yet, and what blocks them."""
    met = notes.filter("state = 'verified'").join(derived.select(F.col("source").alias("id")).distinct(), "id", "left_anti").join(support, "id", "left")
    why = lifecycle.promotion(F.col("n_days"), F.col("relevant"), F.col("scope_known"), F.col("n"), F.col("max_strength"))
    return met.select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_days", F.lit(0)).alias("n_days"), why.alias("blocked"))


def too_broad(principles: DataFrame, support: DataFrame, below: int = BROAD_BELOW) -> DataFrame:
    """(id, n): principles of scope 'always' with fewer observations than below, or with none linked."""
    return principles.filter("validity_scope = 'always'").join(support, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < below)


def stale(conclusions: DataFrame, as_of: Column) -> DataFrame:
    """(id, recheck_at, reasons): conclusions whose re-check is past or that have a reason to be checked."""
    met = conclusions.filter((F.col("recheck_at") < as_of) | (F.size("reasons") > 0))
    return met.select("id", "recheck_at", "reasons")


def unsupported(principles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Principles that no evidence is linked to."""
    return principles.join(evidence.select("id").distinct(), "id", "left_anti")


def weekly_questions(sessions: DataFrame, changes: DataFrame, moves: DataFrame, created: DataFrame, day: str) -> DataFrame:
    """One row per week with the figures behind its five questions.

    1. What was read: sessions, minutes. 2. What changed in view: changed, rows of changes.
    3. What should move into the current pool: promoted, and room that the weekly cap leaves.
    4. What should go: parked, deleted. 5. What should be created: created by kind, rows of
    created (kind). Each table has the column day.
    """
    week = rollups.week_of(F.col(day)).alias("week")
    count = lambda rows, column, *kinds: rows.groupBy(week).agg(*[F.count_if(F.col(column) == x).alias(x) for x in kinds])
    parts = [
        sessions.groupBy(week).agg(F.count("*").alias("sessions"), F.sum("minutes").cast("long").alias("minutes")),
        changes.groupBy(week).agg(F.count("*").alias("changed")),
        count(moves, "action", "promoted", "parked", "deleted"),
        count(created, "kind", "assumption", "experiment", "principle"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.join(more, "week", "full")
    columns = ("sessions", "minutes", "changed", "promoted", "parked", "deleted", "assumption", "experiment", "principle")
    met = out.select("week", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])
    return met.withColumn("room", F.greatest(F.lit(0), F.lit(rollups.WEEKLY_PROMOTIONS) - F.col("promoted")).cast("long"))


def pool_moves(weeks: DataFrame, recommended: DataFrame, current: DataFrame, parked: DataFrame) -> DataFrame:
    """(week, place, item): what should move into the current pool in each week (week, room), as far as its room goes.

    recommended: (item, rank), less rank first, ties by item; current and parked: (item). Candidates are recommended
    items that are neither. No more of them than the weekly cap are ever handed out: a proven bound for the broadcast.
    """
    left = ranking.pool_left(recommended.select("item"), current.select("item"), parked.select("item"))
    first = recommended.groupBy("item").agg(F.min("rank").alias("rank")).join(left, "item", "left_semi").orderBy("rank", "item").limit(rollups.WEEKLY_PROMOTIONS)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("rank", "item"))).select("place", "item")
    return weeks.join(F.broadcast(placed), F.col("place") <= F.col("room")).select("week", "place", "item")


def reopened(loops: DataFrame, as_of: Column) -> DataFrame:
    """Offloaded loops that may be opened again: their time has come or their trigger is met."""
    return loops.filter(F.coalesce(F.col("revisit_at") <= as_of, F.lit(False)) | F.coalesce(F.col("triggered"), F.lit(False)))


def findings(as_of: Column, **parts: DataFrame) -> DataFrame:
    """(query, id, as_of) of several review questions as one stream."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("query"), F.col("id").cast("string").alias("id"), as_of.alias("as_of"))
        out = one if out is None else out.union(one)
    return out
