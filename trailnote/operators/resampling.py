"""Whether a difference between two variants is more than chance: bootstrap intervals and sign flips.

Draws come from a hash of seed, unit and replicate, so they do not depend on partitions, and any
engine with MD5 can repeat them. A unit's draws are one array; all replicates are summed in one
aggregate, which is combined before the shuffle: as many rows as replicates and variants, whatever the units.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailnote.operators.trajectory import PLACES

#: P(count <= k) of a Poisson distribution of mean 1, until it is 1 in 32 bits.
POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(12)]


def drawn(seed: str, unit: Column, replicate: Column) -> Column:
    """A number in [0, 1) in steps of 2**-32."""
    told = F.md5(F.concat(F.lit(f"{seed}:"), unit.cast("string"), F.lit(":"), replicate.cast("string")))
    return F.conv(F.substring(told, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bootstrap(units: DataFrame, unit: str, measures: Mapping[str, tuple[Column, Column]], baseline, variant, replicates: int = 200, seed: str = "bootstrap", level: float = 0.95) -> DataFrame:
    """(measure, baseline, value, delta, low, high, chance) from one row per unit (unit, variant, ...).

    measures: name to (numerator, denominator), summed over units; null counts as nothing in both. Each unit counts
    as often as a Poisson draw of mean 1 says, anew in each replicate. low and high hold the middle level of
    the replicates' deltas; chance is twice the lesser share of deltas on either side of 0, at most 1.
    """
    ids = F.sequence(F.lit(1), F.lit(replicates))
    count = lambda u: sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in POISSON[1:]), F.when(u >= F.lit(POISSON[0]), 1).otherwise(0))
    draws = F.concat(F.array(F.lit(1)), F.transform(ids, lambda r: count(drawn(seed, F.col(unit), r))))
    some = units.filter(F.col("variant").isin(baseline, variant))
    parts = {f"{m}_{side}": F.coalesce(x.cast("double"), F.lit(0.0)) for m, (num, den) in measures.items() for side, x in (("n", num), ("d", den))}
    each = some.select("variant", *[v.alias(c) for c, v in parts.items()], F.posexplode(draws).alias("replicate", "times")).filter("times > 0")
    sums = each.groupBy("variant", "replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in parts])
    long = sums.select("variant", "replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.try_divide(f"{m}_n", f"{m}_d").alias("value")) for m in measures])).alias("x")).select("variant", "replicate", "x.*")
    pick = lambda v: F.max(F.when(F.col("variant") == F.lit(v), F.col("value")))
    met = long.groupBy("measure", "replicate").agg(pick(baseline).alias("a"), pick(variant).alias("b")).withColumn("delta", F.col("b") - F.col("a"))
    again = F.when(F.col("replicate") > 0, F.col("delta"))
    own = lambda c: F.max(F.when(F.col("replicate") == 0, F.col(c)))
    side = lambda ok: F.try_divide(F.count_if(ok(again)).cast("double"), F.count(again))
    out = met.groupBy("measure").agg(
        own("a").alias("baseline"), own("b").alias("value"), own("delta").alias("delta"), F.percentile(again, (1 - level) / 2).alias("low"), F.percentile(again, (1 + level) / 2).alias("high"), F.least(F.lit(1.0), 2 * F.least(side(lambda d: d <= 1e-12), side(lambda d: d >= -1e-12))).alias("chance")
    )
    return out.select("measure", *[F.round(c, PLACES).alias(c) for c in ("baseline", "value", "delta", "low", "high", "chance")])


def sign_flips(pairs: DataFrame, task: str, delta: str, replicates: int = 999, seed: str = "signs") -> DataFrame:
    """One row (tasks, mean_delta, chance) for rows (task, delta): how often random signs give a sum as far from 0.

    chance = (1 + such replicates) / (1 + replicates). Tasks without a delta do not count.
    """
    ids = F.sequence(F.lit(1), F.lit(replicates))
    signs = F.concat(F.array(F.lit(1)), F.transform(ids, lambda r: F.when(drawn(seed, F.col(task), r) < 0.5, 1).otherwise(-1)))
    sums = pairs.filter(F.col(delta).isNotNull()).select(F.col(delta).alias("d"), F.posexplode(signs).alias("replicate", "sign")).groupBy("replicate").agg(F.sum(F.col("d") * F.col("sign")).alias("s"), F.count("*").alias("tasks"))
    whole = F.broadcast(sums.filter("replicate = 0").select(F.col("s").alias("own"), "tasks"))
    met = sums.filter("replicate > 0").select("s").join(whole)
    out = met.groupBy("own", "tasks").agg(F.count_if(F.abs("s") >= F.abs("own") - 1e-9).alias("far"), F.count("*").alias("all"))
    return out.select("tasks", F.round(F.col("own") / F.col("tasks"), PLACES).alias("mean_delta"), F.round((1 + F.col("far")) / (1 + F.col("all")), PLACES).alias("chance"))
