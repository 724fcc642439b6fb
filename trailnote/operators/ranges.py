"""Ordered work on rows that Spark cut into ranges, where a key may fill several of them.

Rows carry the number of their range as _part. A range goes on with at most one key of the range
before it, so what is handed from range to range is fewer rows than there are ranges: a
proven bound for a broadcast, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailnote.sources.tables import landed


def continued(heads: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Of heads (_part, keys, value), one row per range and key, those that got a value from an earlier range."""
    return heads.filter(F.col(value).isNotNull()).select(F.col("_part").alias("_of_part"), *[F.col(k).alias(f"_of_{k}") for k in keys], value)


def from_range_before(parts: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parts with what continued heads hand to their range and key, null elsewhere."""
    on = F.col("_part") == F.col("_of_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return parts.join(F.broadcast(heads), on, "left").drop("_of_part", *[f"_of_{k}" for k in keys])


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows with place, from 1, among those equal in by. order should leave no ties.

    Each range numbers its own rows, and a key that goes on from earlier ranges adds what these hold.
    """
    parts = landed(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = parts.groupBy("_part", *by).agg(F.count("*").alias("_n")).withColumn("_before", before)
    place = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) + F.coalesce("_before", F.lit(0))
    return from_range_before(parts, continued(heads, by, "_before"), by).withColumn("place", place).drop("_part", "_before")


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """rows landed in ranges of by and order, with the number of its range as _part."""
    return landed(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def running(parts: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """parts (from ranged) with each of sums as the sum over all earlier rows equal in by, 0 for the first. order should leave no ties."""
    names = list(sums)
    parts = parts.withColumns({f"_v_{c}": v for c, v in sums.items()})
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.groupBy("_part", *by).agg(*[F.sum(f"_v_{c}").alias(f"_v_{c}") for c in names]).select("_part", *by, F.struct(*[F.sum(f"_v_{c}").over(before).alias(c) for c in names]).alias("_before"))
    heads = heads.filter(F.col(f"_before.{names[0]}").isNotNull())
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = from_range_before(parts, continued(heads, by, "_before"), by)
    total = {c: F.coalesce(F.sum(f"_v_{c}").over(inside), F.lit(0)) + F.coalesce(F.col(f"_before.{c}"), F.lit(0)) for c in names}
    return met.withColumns(total).drop("_before", *[f"_v_{c}" for c in names])
