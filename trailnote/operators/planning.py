"""The best policy that a budget of steps allows, and what a given policy is worth within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.operators.trajectory import PLACES
from trailnote.sources.tables import landed

#: Steps after which the lineage is cut.
CUT = 4


def _outcomes(moves: DataFrame) -> DataFrame:
    """(state, action, next_state, q) of counted moves (state, action, next_state, n)."""
    known = moves.filter("state IS NOT NULL AND action IS NOT NULL AND next_state IS NOT NULL AND n > 0")
    total = known.groupBy("state", "action").agg(F.sum("n").alias("total"))
    return landed(known.join(total, ["state", "action"]).select("state", "action", "next_state", (F.col("n") / F.col("total")).alias("q")), "outcomes")


def _values(outcomes: DataFrame, value: DataFrame, goals: Sequence[str], failures: Sequence[str]) -> DataFrame:
    """(state, action, v): chance to reach a goal when action is taken and value (state, value) holds for what comes after."""
    inner = outcomes.filter(~F.col("state").isin(*goals, *failures))
    after = F.when(F.col("next_state").isin(*goals), 1.0).when(F.col("next_state").isin(*failures), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    met = inner.join(value.select(F.col("state").alias("next_state"), "value"), "next_state", "left")
    return met.groupBy("state", "action").agg(F.sum(F.col("q") * after).alias("v"))


def best_policy(moves: DataFrame, goals: Sequence[str], failures: Sequence[str], budget: int, allowed: DataFrame | None = None) -> DataFrame:
    """(steps_left, state, action, value) for 1..budget steps: the action with the greatest chance to reach a goal in time, ties by name.

    moves: counted (state, action, next_state, n); allowed: (state, action), all if None. States without an allowed
    action, goals and failures have no row. By backward induction: a join along the moves and two sums a
    step; a table has at most a row for each move, the result one for each state and step.
    """
    outcomes = _outcomes(moves)
    if allowed is not None:
        outcomes = landed(outcomes.join(allowed.select("state", "action").distinct(), ["state", "action"], "left_semi"), "allowed-outcomes")
    steps, value = [], outcomes.select("state", F.lit(0.0).alias("value")).filter(F.lit(False))
    for k in range(1, budget + 1):
        # Rounded to 12 places, so sums taken in another order make no other tie.
        best = _values(outcomes, value, goals, failures).groupBy("state").agg(F.min(F.struct((-F.round("v", 12)).alias("less"), "action")).alias("best"))
        now = best.select(F.lit(k).alias("steps_left"), "state", "best.action", (-F.col("best.less")).alias("value"))
        now = landed(now, "best-policy") if k % CUT == 0 or k == budget else now
        steps.append(now)
        value = now.select("state", "value")
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return out.select("steps_left", "state", "action", F.round("value", PLACES).alias("value"))


def policy_value(moves: DataFrame, policy: DataFrame, goals: Sequence[str], failures: Sequence[str], budget: int) -> DataFrame:
    """(state, value) of policy (state, action, p) with budget steps left; states that the policy says nothing of have none."""
    outcomes = _outcomes(moves)
    policy = landed(policy.filter("p > 0").select("state", "action", "p"), "policy")
    value = outcomes.select("state", F.lit(0.0).alias("value")).filter(F.lit(False))
    for k in range(1, budget + 1):
        value = _values(outcomes, value, goals, failures).join(policy, ["state", "action"]).groupBy("state").agg(F.sum(F.col("p") * F.col("v")).alias("value"))
        value = landed(value, "policy-value") if k % CUT == 0 and k < budget else value
    return value.select("state", F.round("value", PLACES).alias("value"))
