"""Ordered windows, top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailnote.operators.ranges import numbered


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by order, as one aggregate: hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def review_due(notes: DataFrame, as_of: Column, key: str, due: str, k: int) -> DataFrame:
    """(key, due, days_left): the k notes whose review comes first; negative days are overdue. Ties by key."""
    return notes.filter(F.col(due).isNotNull()).select(key, due, F.datediff(F.col(due), as_of).alias("days_left")).orderBy(due, key).limit(k)


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, start, length) of each unbroken run of days. Days are distinct first, so a key has one row a day."""
    once = days.select(key, F.to_date(day).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    return once.withColumn("island", island).groupBy(key, "island").agg(F.min("day").alias("start"), F.count("*").alias("length")).drop("island")


def ranked(values: DataFrame, by: Column, tie: str) -> DataFrame:
    """values with rank, 1 first."""
    return numbered(values, (), [by, F.col(tie)]).withColumn("rank", F.col("place").cast("int")).drop("place")


def by_priority(rows: DataFrame, priority: str, tie: str, k: int) -> DataFrame:
    """The k rows of most urgent priority; labels such as P0 < P1 sort as text, an empty one last."""
    return rows.orderBy(F.col(priority).asc_nulls_last(), tie).limit(k)


def at_most(rows: DataFrame, key: str, order: Sequence[Column], most: int = 3) -> DataFrame:
    """rows with place in their group and excess for those beyond the limit; none is dropped."""
    return numbered(rows, (key,), order).withColumn("place", F.col("place").cast("int")).withColumn("excess", F.col("place") > most)


def united(*kinds: DataFrame) -> DataFrame:
    """Typed notes as one stream; fields a kind lacks are null."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in both: empty for goal and failure sets that are well formed."""
    return a.intersect(b)


def pool_left(recommended: DataFrame, current: DataFrame, parked: DataFrame) -> DataFrame:
    """Recommended items that are neither current nor parked."""
    return recommended.subtract(current).subtract(parked)
