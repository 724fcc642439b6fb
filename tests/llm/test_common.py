"""Tables that only a finished step needed are deleted, also after an error, and nothing else is."""

import os

import pytest
from pyspark.sql import functions as F

from trailnote.llm.common import landed, scratch, settled, shared_dir


def tables(spark, name):
    folder = shared_dir(spark).removeprefix("file://")
    return sorted(x for x in os.listdir(folder) if x.startswith(f"trailnote-{name}-")) if os.path.isdir(folder) else []


def test_settled_keeps_only_its_result(spark):
    def build():
        a = landed(spark.range(10), "inner-a")
        b = settled(spark, "inner-b", lambda: landed(a.filter("id > 3"), "inner-c").filter("id < 8"))
        assert tables(spark, "inner-c") == [] and len(tables(spark, "inner-b")) == 1
        return a.join(b, "id").groupBy().agg(F.sum("id").alias("s"))

    outer = landed(spark.range(3), "outer")
    out = settled(spark, "result", build)
    assert out.first().s == 4 + 5 + 6 + 7
    assert tables(spark, "inner-a") == tables(spark, "inner-b") == [] and len(tables(spark, "result")) == 1
    assert outer.count() == 3


def test_scratch_clears_after_an_error(spark):
    with pytest.raises(KeyError), scratch(spark):
        landed(spark.range(3), "lost")
        raise KeyError
    assert tables(spark, "lost") == []
