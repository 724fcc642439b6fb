"""Times to a goal or a failure with runs that reach neither: product-limit survival and competing risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.operators.ranges import ranged, running
from trailnote.operators.trajectory import PLACES
from trailnote.sources.tables import landed


def outcomes(taus: DataFrame) -> DataFrame:
    """taus (run_id, n_steps, tau_g, tau_f, ...) with time and kind: goal or failure, whichever is first (failure of equals), else censored at the last step."""
    goal = F.col("tau_g").isNotNull() & (F.col("tau_f").isNull() | (F.col("tau_g") < F.col("tau_f")))
    kind = F.when(goal, "goal").when(F.col("tau_f").isNotNull(), "failure").otherwise("censored")
    return taus.withColumns({"kind": kind, "time": F.when(goal, F.col("tau_g")).otherwise(F.coalesce("tau_f", F.col("n_steps") - 1))})


def risks(ended: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, time, at_risk, goals, failures, censored, survival, p_goal, p_failure) of rows (by, time, kind), one row per time.

    at_risk: runs that have not ended before time; who is censored at a time still counts there. survival: the
    share that gets beyond time without an end, had none been cut off (Kaplan-Meier). p_goal and p_failure:
    the chance to have ended so by time, each with the other as a competing risk (Aalen-Johansen); with
    survival they add up to 1. Running sums go over ranges of time, not through one task.
    """
    counts = ended.groupBy(*by, "time").agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in (("goal", "goals"), ("failure", "failures"), ("censored", "censored"))])
    parts = ranged(counts, by, ["time"])
    total = parts.groupBy(*by).agg(F.sum(F.col("goals") + F.col("failures") + F.col("censored")).alias("runs"))
    gone = running(parts, by, ["time"], {"gone": F.col("goals") + F.col("failures") + F.col("censored")})
    gone = gone.join(F.broadcast(total)) if not by else gone.join(total, list(by))
    # Summed logarithms; a factor of 0 ends all that follows.
    died = (F.col("goals") + F.col("failures")).cast("double")
    factor = 1 - died / F.col("at_risk")
    at = landed(gone.select("_part", *by, "time", (F.col("runs") - F.col("gone")).alias("at_risk"), "goals", "failures", "censored").withColumn("factor", factor), "at-risk")
    all_gone = (F.col("goals") + F.col("failures") == F.col("at_risk")).cast("long")
    log = F.when(all_gone == 1, F.lit(0.0)).otherwise(F.log("factor"))
    before = running(at, by, ["time"], {"logs": log, "zeros": all_gone}).withColumn("just_before", F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("logs")))
    before = landed(before.drop("logs", "zeros"), "survival")
    share = lambda c: F.col("just_before") * F.col(c) / F.col("at_risk")
    done = running(before, by, ["time"], {"g": share("goals"), "f": share("failures")})
    return done.select(*by, "time", "at_risk", "goals", "failures", "censored", F.round(F.col("just_before") * F.col("factor"), PLACES).alias("survival"), F.round(F.col("g") + share("goals"), PLACES).alias("p_goal"), F.round(F.col("f") + share("failures"), PLACES).alias("p_failure"))
