"""Rules by which notes change state.

A transition log (id, from_state, to_state, at) is only ever appended to; a note's state is
its latest entry. Guards give reasons instead of silently refusing. Dates are parameters,
never the clock, so that every answer can be made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailnote.sources.templates import MOVES

#: Observations that make support repeated; qualities out of five that make evidence strong.
REPEATED, STRONG = 2, 4
# Reasons to check a conclusion again.
RECHECK = ("context changed", "cost went up", "conflicting evidence", "short window")


def disallowed(transitions: DataFrame) -> DataFrame:
    """Transitions that are none of MOVES. The table of moves has a handful of rows."""
    moves = transitions.sparkSession.createDataFrame(list(MOVES), "from_state string, to_state string")
    return transitions.join(F.broadcast(moves), ["from_state", "to_state"], "left_anti")


def current_state(transitions: DataFrame) -> DataFrame:
    """(id, state, since): the latest entry by time; of equal times the state that is last by name."""
    return transitions.groupBy("id").agg(F.max(F.struct("at", "to_state")).alias("x")).select("id", F.col("x.to_state").alias("state"), F.col("x.at").alias("since"))


def with_plan(notes: DataFrame, experiments: DataFrame) -> DataFrame:
    """Notes that some experiment is meant to test: what lets them leave the inbox."""
    return notes.join(experiments.select(F.col("related_assumption").alias("id")).distinct(), "id", "left_semi")


def evidence_strength(repeated: Column, behavioral: Column, against_baseline: Column, recorded_close: Column, decision_relevant: Column) -> Column:
    """How many of five qualities evidence has: repeated over time, visible in behavior and not only intention, compared against a baseline, recorded close to when it happened, relevant to a decision outcome. Unknown ones do not count."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (repeated, behavioral, against_baseline, recorded_close, decision_relevant)), F.lit(0))


def support(evidence: DataFrame) -> DataFrame:
    """(id, n, n_days, max_strength) of evidence (id, date, strength)."""
    return evidence.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("date").alias("n_days"), F.max("strength").alias("max_strength"))


def enough_evidence(notes: DataFrame, support: DataFrame, least: int = REPEATED) -> DataFrame:
    """notes with n, n_days, max_strength and enough: at least so much evidence is linked."""
    met = notes.join(support, "id", "left")
    return met.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("enough", F.coalesce("n", F.lit(0)) >= least)


def outweighs_one_off(n: Column, max_strength: Column, relevant: Column) -> Column:
    """One observation makes no principle unless it is unusually strong and bears on a decision."""
    return F.coalesce(n >= REPEATED, F.lit(False)) | F.coalesce((max_strength >= STRONG) & relevant, F.lit(False))


def promotion(n_days: Column, relevant: Column, scope_known: Column, n: Column, max_strength: Column) -> Column:
    """array of what keeps a verified note from being a principle; empty if nothing does."""
    reasons = F.array(
        F.when(~F.coalesce(n_days >= REPEATED, F.lit(False)), "not repeated"),
        F.when(~F.coalesce(relevant, F.lit(False)), "changes no decision"),
        F.when(~F.coalesce(scope_known, F.lit(False)), "scope unknown"),
        F.when(~outweighs_one_off(n, max_strength, relevant), "one-off"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def recheck_reasons(*flags: Column) -> Column:
    """array of the reasons of RECHECK whose flag holds."""
    return F.filter(F.array(*[F.when(f, F.lit(why)) for why, f in zip(RECHECK, flags, strict=True)]), lambda x: x.isNotNull())


def requested(current: DataFrame, requests: DataFrame, plans: DataFrame, support: DataFrame) -> DataFrame:
    """(id, from_state, to_state, at, refused): requests (id, to_state, at) held against the rules.

    Rows with refused null may be appended to the log; nothing is moved.
    """
    moves = requests.sparkSession.createDataFrame(list(MOVES), "from_state string, to_state string").withColumn("allowed", F.lit(True))
    planned = plans.select(F.col("related_assumption").alias("id")).distinct().withColumn("planned", F.lit(True))
    met = requests.join(current.select("id", F.col("state").alias("from_state")), "id", "left").withColumn("from_state", F.coalesce("from_state", F.lit("inbox")))
    met = met.join(F.broadcast(moves), ["from_state", "to_state"], "left").join(planned, "id", "left").join(support.select("id", "n"), "id", "left")
    why = F.when(F.col("allowed").isNull(), "no such move").when((F.col("to_state") == "active") & F.col("planned").isNull(), "no plan").when(F.col("to_state").isin("verified", "falsified") & (F.coalesce("n", F.lit(0)) < REPEATED), "too little evidence")
    return met.select("id", "from_state", "to_state", "at", why.alias("refused"))
