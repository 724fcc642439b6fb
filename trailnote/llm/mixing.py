"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and n of N documents is repeated w * N * budget / n
times on average. Each document draws its own count: a Poisson distribution with that mean
is inverted at a uniform number made from a hash of seed and doc_id, so counts depend on
nothing but the row, and a lost task redraws the same. Means above PART are drawn as sums of
independent parts. Documents are exploded by their counts and dealt into a global order by a
second hash.

Only one row per source is shuffled for the counts; the documents meet that table by
broadcast where the planner finds its file small enough and by a sort-merge join beyond. A
hot source needs no task of its own: drawing works row by row.

Defined cases: null source is a source of its own; a source that the weights leave out gets
no copies; rows repeated whole draw equal counts; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import landed, packed, unpacked

PART = 16
#: Poisson(PART) exceeds this with probability below 1e-26.
MOST = 80
SEED = "mix-1"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits of an MD5 hash."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, budget: float, source: str) -> DataFrame:
    """(source, n, rate, parts, cdf): cdf[k] = P(X <= k) for a Poisson X of mean rate / parts."""
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    counts = landed(counts, "source-counts")
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("sources"))
    if weights is None:
        weight = F.lit(1.0) / F.col("sources")
    else:
        whole = float(sum(weights.values()))
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / whole)]), F.coalesce("source", F.lit(""))), F.lit(0.0))
    rate = weight * F.col("total") * budget / F.col("n")
    # totals is one row by construction.
    rows = counts.join(F.broadcast(totals)).select("source", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf")),
        lambda s, k: F.struct((s["term"] * mean / k).alias("term"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + s["term"] * mean / k).alias("cdf")),
        lambda s: s["cdf"],
    )
    return landed(rows.withColumn("cdf", grown), "source-rates")


def drawn(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: str = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per copy: (row struct of docs' columns, doc_id, source, rate, copy, order_key)."""
    table = rates(docs, weights, budget, source)
    rows = docs.select(packed(docs), F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"))
    met = rows.join(table.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    part = lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), name, i.cast("string"))))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), part), F.lit(0), lambda a, x: a + x)
    copies = met.select("row", "doc_id", "source", "rate", count.alias("count")).filter("count > 0").select("row", "doc_id", "source", "rate", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    return copies.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string"))))


def mixed_sources(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, each row as often as drawn, in the global order."""
    out = drawn(docs, **options)
    return out.orderBy("order_key", "doc_id", "copy").select(*[unpacked(c) for c in docs.columns])


ORACLE = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM counts)) * (SELECT sum(n) FROM counts) * 1.0::DOUBLE / n AS rate FROM counts),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::INT AS parts FROM rates),
terms AS (SELECT source, rate, parts, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) AS term FROM parts, range(0, {MOST + 1}) t(k)),
cdf AS (SELECT source, rate, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
cuts AS (SELECT source, any_value(rate) AS rate, any_value(parts) AS parts, list(below ORDER BY k) AS cuts FROM cdf GROUP BY source),
draws AS (SELECT d.doc_id, d.source, c.rate, p.i, c.cuts, ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || p.i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM documents d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source, LATERAL (SELECT unnest(range(1, c.parts + 1)) AS i) p),
copies AS (SELECT doc_id, source, rate, sum(len(list_filter(cuts, lambda c: c <= u)))::BIGINT AS n FROM draws GROUP BY doc_id, source, rate)
SELECT doc_id, source, round(rate, 6) AS rate, i::INT AS copy, md5('{SEED}-order:' || doc_id || ':' || i) AS order_key
FROM copies, LATERAL (SELECT unnest(range(1, n + 1)) AS i)
"""


def replicas(docs: DataFrame) -> DataFrame:
    """(doc_id, source, rate, copy, order_key) in the global order, every source to the same weight."""
    return drawn(docs).select("doc_id", "source", F.round("rate", 6).alias("rate"), "copy", "order_key").orderBy("order_key", "doc_id", "copy")
