"""Plans of the adopted queries."""

import __spark_entry__ as entry


def test_sketches_are_not_kept_for_each_distinct_value(spark, data):
    found = entry.queries()["a_approximate_counts"](spark, data)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("keys=[l_partkey" in line and ("approx" in line or "percentile" in line) for line in plan.splitlines())
    assert found.first().parts_within and found.first().median_within
