"""Loops of one or more states: the maximal periodic stretches of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a run that one window task holds.
WIDTH = 4096


def periodic_stretches(traj: DataFrame, token: Sequence[str] = ("state",), longest: int = 8, width: int = WIDTH) -> DataFrame:
    """(run_id, start, period, repeats, length): stretches of steps that repeat their first period tokens at least once.

    token: the columns that have to be equal, so (state, action) tells a retry with equal arguments from one
    with others. A stretch is as long as it goes; its period is its shortest, from 1 (staying) to longest.
    Parts of a repeat at the end count in length, not in repeats.

    Step and step + period are compared within buckets of width steps, which borrow longest + 1 steps from
    the next one and one from the last; what is handed on are the ends of equal runs only, and
    starts are carried from bucket to bucket. A run with a third of all steps spreads over its buckets.
    """
    t = F.struct(*[F.col(c) for c in token])
    rows = traj.select("run_id", "step", t.alias("t"), F.floor(F.col("step") / width).alias("bucket"))
    inside = F.col("step") % width
    owned = rows.withColumn("own", F.lit(True))
    later = rows.filter((inside <= longest) & (F.col("bucket") > 0)).withColumns({"bucket": F.col("bucket") - 1, "own": F.lit(False)})
    last = rows.filter(inside == width - 1).withColumns({"bucket": F.col("bucket") + 1, "own": F.lit(False)})
    window = Window.partitionBy("run_id", "bucket").orderBy("step")
    same = lambda p: F.lead(F.struct("t")).over(window) if p == 0 else F.coalesce(F.lead(F.struct("t"), p).over(window)["t"] == F.col("t"), F.lit(False))
    met = owned.union(later).union(last)
    met = met.select("run_id", "bucket", "step", "own", *[same(p).alias(f"m{p}") for p in range(1, longest + 1)])
    there = lambda f, p: F.coalesce(f(f"m{p}").over(window), F.lit(False))
    ends = F.array(*[F.struct(F.lit(p).alias("period"), (F.col(f"m{p}") & ~there(F.lag, p)).alias("begins"), (F.col(f"m{p}") & ~there(F.lead, p)).alias("ends")) for p in range(1, longest + 1)])
    bounds = met.select("run_id", "bucket", "step", "own", ends.alias("x")).filter("own")
    bounds = bounds.select("run_id", "bucket", "step", F.explode(F.filter("x", lambda x: x.begins | x.ends)).alias("x")).select("run_id", "bucket", "step", "x.*")

    keys = ["run_id", "period"]
    begin = F.when(F.col("begins"), F.col("step"))
    heads = bounds.groupBy(*keys, "bucket").agg(F.max(begin).alias("head"))
    earlier = heads.select(*keys, "bucket", F.max("head").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")).filter("earlier IS NOT NULL")
    near = F.max(begin).over(Window.partitionBy(*keys, "bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    found = bounds.withColumn("near", near).filter("ends").join(earlier, [*keys, "bucket"], "left")
    found = found.select("run_id", "period", F.coalesce("near", "earlier").alias("start"), (F.col("step") + F.col("period")).alias("last")).filter(F.col("last") - F.col("start") + 1 >= 2 * F.col("period"))
    # A stretch with a shorter period has it from the same start to the same end.
    least = found.groupBy("run_id", "start", "last").agg(F.min("period").alias("period"))
    length = F.col("last") - F.col("start") + 1
    return least.select("run_id", "start", F.col("period").cast("long").alias("period"), F.floor(length / F.col("period")).alias("repeats"), length.alias("length"))
