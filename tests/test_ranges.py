"""Numbering and as-of joins where one key fills many ranges, against plain Python."""

import pytest
from pyspark.sql import functions as F

from trailnote.operators import linkage, ranking


@pytest.fixture
def small_ranges(spark):
    """No coalescing, so that a few thousand rows fill all ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_of_a_hot_key(spark, small_ranges):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.when(F.col("id") % 30 != 2, F.col("id") % 11)).alias("key"), (F.col("id") * 7919 % 3001).alias("v"), "id")
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id)):
        want.setdefault(r.key, []).append(r.id)
    got = ranking.at_most(rows, "key", [F.desc("v"), F.col("id")]).collect()
    assert len(got) == 3000
    for r in got:
        assert want[r.key][r.place - 1] == r.id and r.excess == (r.place > 3)


def test_ranks_of_all_rows(spark, small_ranges):
    rows = spark.range(2000).select((F.col("id") % 50).alias("v"), "id")
    got = ranking.ranked(rows, F.desc("v"), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [r.id for r in sorted(got, key=lambda r: (-r.v, r.id))]
    assert {r["rank"] for r in got} == set(range(1, 2001))


def test_empty_rows(spark):
    assert ranking.ranked(spark.range(0).select(F.col("id").alias("v"), "id"), F.desc("v"), "id").count() == 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_as_of_with_hot_keys_and_moments(spark, small_ranges, keys):
    k = F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5)
    t = F.when(F.col("id") % 4 == 0, 500).otherwise(F.when(F.col("id") % 97 != 0, F.col("id") * 31 % 1000))
    facts = spark.range(3000).select("id", k.alias("k"), t.alias("at"))
    periods = spark.range(40).select((F.col("id") % 6).alias("k"), F.when(F.col("id") != 9, F.col("id") * 37 % 990).alias("start"), F.col("id").alias("p"))
    if not keys:
        periods = periods.drop("k")
    told = periods.collect()
    got = linkage.as_of(facts, periods, "at", keys=keys).collect()
    assert len(got) == 3000
    for r in got:
        fit = [(x.start, x.p) for x in told if (not keys or x.k == r.k) and x.start is not None and r["at"] is not None and x.start <= r["at"]]
        assert (r.start, r.p) == max(fit, default=(None, None))
