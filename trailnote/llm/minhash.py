"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. One pass over the texts gives each document its shingle-set size, a 128-bit key of the
   whole set and PERMUTATIONS min-hashes. Equal sets become one class, whose smallest
   doc_id stands for it: thousands of copies cost one row each and never form pairs.
2. Class representatives meet in BANDS buckets of ROWS min-hashes. First every member of a
   bucket is paired with the bucket's hub only. Links found there are joined to components.
   Members of one bucket that are still in different components are paired directly where
   the bucket is small; members of larger ones meet in an exact join on their rarest
   differences from the cluster's center, one for all with the same differences. No candidate pair is lost, and
   neither a bucket of mutual copies nor one of variants of a text or of texts from a template gives all its pairs.
3. Pairs are pruned by size ratio, then by comparing signatures in batches: a pair goes as
   soon as the posterior probability (uniform prior) that its similarity reaches the
   threshold falls below MISS. Survivors are verified on their full shingle sets.

A pair at the threshold similarity s is never in a common bucket with probability
(1 - s**ROWS) ** BANDS: 7e-9 at 0.85, 3e-6 at 0.8.

Defined cases: null, empty or blank text has an empty set and links with nothing; rows
repeated whole are one document, returned as often as they came; a null doc_id is kept,
linked with nothing, and has a null component. Of unlike texts of one doc_id one, the
smallest by its shingles, stands for the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import keyed, landed, mapped, mixed, quoted, settled, shingle_sets, steps

ROWS, BANDS = 5, 32
PERMUTATIONS = ROWS * BANDS
BATCH = 16
#: Members of one bucket up to which those in different components are paired directly.
PAIRED = 32
MISS = 1e-6

_ZERO = np.zeros(1, np.uint64)
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of PERMUTATIONS 32-bit min-hashes per non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), PERMUTATIONS), np.uint32)
    if len(full):
        for k in range(PERMUTATIONS):
            out[:, k] = np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], bounds[:-1][full]) >> np.uint64(32)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            hashes, bounds = shingle_sets(data, offsets)
            sizes = np.diff(bounds)
            signs = signatures(hashes, bounds)
            keyed_by = np.stack([np.diff(np.concatenate([_ZERO, np.cumsum(x)])[bounds]) for x in (hashes, mixed(hashes + np.uint64(11)))], 1)
            keys, sigs, row = [], [], 0
            for i, n in enumerate(sizes):
                if n:
                    keys.append(keyed_by[i].tobytes())
                    sigs.append(signs[row].tobytes())
                    row += 1
                else:
                    keys.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n", "set_key", "sig"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.zeros(sig.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        ids, sizes = (np.repeat(batch.column(i).to_numpy(), BANDS) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids), pa.array(sizes)], ["band", "id", "n"])


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches compared: the fewest matches with which a pair stays.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _pruned(least: list[int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for i in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
                alive = alive[matches[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return prune


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, data, offsets in steps(batch.column(0), batch.column(1)):
            hashes, bounds = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))], ["id", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of links (a, b) the smallest id it reaches.

    Every round takes the smallest label among neighbours and then the label's own label,
    so a chain halves in length each round; partial minima keep hub nodes cheap.
    """
    both = landed(links.select("a", "b").union(links.select("b", "a")).distinct(), "arcs")
    labels = landed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.least("component", "heard").alias("near"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        after = landed(lower.join(jump, "near", "left").select("id", F.least("near", "far").alias("component"), "was"), "labels")
        changed = after.filter("component <> was").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, id, more, less, rarity): shingles that a member has beyond its center, those it lacks, and how many members lack each of these."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            more, less, rarity = [], [], []
            for shingles, center, lacking in zip(*(part.column(k) for k in (2, 3, 4))):
                own = shingles.values.to_numpy()
                every, missed = (x.values.to_numpy() if x.is_valid else _ZERO[:0].view(np.int64) for x in (center, lacking))
                more.append(np.setdiff1d(own, every, assume_unique=True))
                gone = ~np.isin(every, own, assume_unique=True)
                less.append(every[gone])
                rarity.append(missed[gone])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x).astype(np.int64))) for x in (more, less, rarity)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["cluster", "id", "more", "less", "rarity"])


def _around_centers(torn: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (band, id, n, component): pairs (a, b) that link all close to a center, prefix rows in which all other links meet, and patterns.

    A pattern (cluster, p, q) is what a member's delta may share with others: all its elements but those that it alone has or lacks.

    Buckets that share members form clusters. A cluster's center is the set of shingles that
    most members have; delta is what a member has more or less than it. Sets i and j are
    linked exactly if (100 + p) * |delta_i ^ delta_j| <= (100 - p) * (n_i + n_j), so with
    weight = (100 + p) * |delta| - (100 - p) * n their deltas share at least
    alpha = ceil((weight_i + weight_j) / (2 * (100 + p))) elements.
    alpha <= 0: both lie close to the center and are linked for certain, and so is each of
    them with the member of least weight; pairs with that member stand for all of these.
    alpha >= 1: they share one of the |delta| - alpha + 1 rarest elements of either delta.
    What only one member has or lacks comes first in that order and meets nothing, so it is
    counted and never joined: thousands of variants of one text, each with edits of its own,
    give few rows.
    """
    up, down = 100 + percent, 100 - percent
    hubs = torn.groupBy("band").agg(F.min("id").alias("a"))
    cluster = components(torn.join(hubs, "band").filter("a <> id").select("a", F.col("id").alias("b")))
    ids = landed(torn.select("id", "n", "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id"), "clustered")
    sets = mapped(docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), _sets, "id long, shingles array<long>").groupBy("id").agg(F.min("shingles").alias("shingles"))
    own = landed(sets.join(ids, "id").select("cluster", "id", "shingles"), "own-sets")
    members = ids.groupBy("cluster").agg(F.count("*").alias("m"))
    counted = landed(own.select("cluster", F.explode("shingles").alias("e")).groupBy("cluster", "e").agg(F.count("*").alias("df")).filter("df > 1").join(members, "cluster"), "shingle-counts")
    center = landed(counted.filter("2 * df > m").groupBy("cluster").agg(F.collect_list("e").alias("center"), F.collect_list(F.col("m") - F.col("df")).alias("lacking")), "centers")
    delta = landed(mapped(own.join(center, "cluster", "left").select("cluster", "id", "shingles", "center", "lacking"), _deltas, "cluster long, id long, more array<long>, less array<long>, rarity array<long>"), "deltas")
    more = delta.select("cluster", "id", F.explode("more").alias("e")).join(counted.filter("2 * df <= m"), ["cluster", "e"]).groupBy("id").agg(F.collect_list(F.struct(F.col("df").alias("rarity"), "e")).alias("shared"))
    less = F.filter(F.arrays_zip("rarity", F.col("less").alias("e")), lambda x: x.rarity > 1)
    weighed = delta.select("id", (F.size("more") + F.size("less")).alias("size"), less.alias("less")).join(more, "id", "left")
    weighed = weighed.select("id", "size", F.array_sort(F.concat("less", F.coalesce("shared", F.array().cast("array<struct<rarity:bigint,e:bigint>>")))).alias("shared"))
    weighed = landed(ids.join(weighed, "id").withColumn("weight", up * F.col("size") - down * F.col("n")), "weighed")
    least = weighed.groupBy("cluster").agg(F.min(F.struct("weight", "id", "component")).alias("mid"))
    close = weighed.join(least, "cluster").filter(F.col("id") != F.col("mid.id")).filter(F.col("weight") + F.col("mid.weight") <= 0).filter(F.col("component") != F.col("mid.component"))
    close = close.select(F.least("id", "mid.id").alias("a"), F.greatest("id", "mid.id").alias("b"))
    bound = F.greatest(F.lit(1), F.ceil((F.col("weight") - down * 100 / percent * F.col("n") - 1e-6) / up))
    alone = F.col("size") - F.size("shared")
    prefix = weighed.select("cluster", "id", "n", "component", "size", "weight", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("size") - bound + 1 - alone).cast("int"))).alias("at", "x"))
    prefix = landed(prefix.select("cluster", F.col("x.e").alias("e"), "id", "n", "component", "size", "weight", (F.col("alone") + F.col("at")).alias("at")), "prefixes")
    return close, prefix, weighed.select("cluster", "id", "weight", F.size("shared").alias("n_shared"), F.xxhash64("shared").alias("p"), F.xxhash64(F.lit(1), "shared").alias("q"))


def _meetings(prefix: DataFrame, percent: int, hubs: bool) -> DataFrame:
    """Pairs (a, b) of prefix rows of one element that may be linked: with the element's hub, or all.

    low and high hold a row's components; rows that all stand for one component need not meet.
    """
    fields = ["id", "n", "low", "high", "size", "weight", "at"]
    rows = prefix.select("cluster", "e", F.struct(*fields).alias("r"))
    left = prefix.groupBy("cluster", "e").agg(F.min(F.struct(*fields)).alias("l"), F.count("*").alias("rows")).filter("rows > 1").drop("rows") if hubs else rows.withColumnRenamed("r", "l")
    alpha = F.greatest(F.lit(1), F.ceil((F.col("l.weight") + F.col("r.weight")) / (2 * (100 + percent))))
    reach = (F.col("l.at") <= F.col("l.size") - alpha) & (F.col("r.at") <= F.col("r.size") - alpha) & (100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n"))
    differ = (F.least("l.low", "r.low") < F.greatest("l.high", "r.high"))
    # Pairs close to the center are linked by way of it; only heads of patterns need them here.
    far = (F.col("l.weight") + F.col("r.weight") > 0) if hubs else F.lit(True)
    met = left.join(rows, ["cluster", "e"]).filter((F.col("l.id") < F.col("r.id")) & differ & reach & far)
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _by_patterns(prefix: DataFrame, patterns: DataFrame, linked: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) with what is still apart in prefix rows: patterns meet instead of their members.

    All members of two patterns share as many elements, so two members are linked exactly if their weights
    add up to little enough. Then each is linked with the other pattern's lightest member as well, and so is one of a pattern
    with its own lightest. So only lightest members (heads) meet in the exact prefix join, and a pattern's members
    then meet the heads of their own pattern and of those that it is linked with: thousands of texts from one template, with
    few patterns between them, give pairs in proportion to their number.
    """
    current = lambda rows: rows.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = current(patterns)
    heads = own.groupBy("cluster", "p", "q").agg(F.min(F.struct("weight", "id", "component")).alias("head"), F.min("component").alias("low"), F.max("component").alias("high"))
    own = landed(own.join(heads, ["cluster", "p", "q"]).select("id", "weight", "n_shared", "component", "low", "high", F.col("head.id").alias("head"), F.col("head.weight").alias("head_weight"), F.col("head.component").alias("head_component")), "patterns")
    rows = landed(prefix.join(own.filter("id = head").select("id", "low", "high"), "id"), "head-prefixes")
    apart = rows.groupBy("cluster", "e").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("cluster", "e")
    rows = rows.join(apart, ["cluster", "e"], "left_semi")
    stars = own.filter("id <> head AND component <> head_component").filter(F.col("weight") + F.col("head_weight") <= 2 * (100 + percent) * F.col("n_shared")).select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    between = landed(_meetings(landed(rows, "apart"), percent, hubs=False), "pattern-pairs")
    found = verify(between.union(stars).distinct())
    if found.isEmpty():
        return links, linked
    links = links.union(found)
    linked = components(links)
    # Members of linked patterns with the other one's head, where they are still apart.
    sides = found.join(between, ["a", "b"], "left_semi")
    sides = sides.select(F.col("a").alias("head"), F.col("b").alias("other")).union(sides.select("b", "a"))
    met = current(own.select("id", "head").filter("id <> head")).join(sides, "head").join(current(own.select("id")).select(F.col("id").alias("other"), F.col("component").alias("other_component")), "other")
    rest = landed(met.filter("component <> other_component").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "pattern-members")
    if rest.isEmpty():
        return links, linked
    links = links.union(verify(rest))
    return links, components(links)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those with 100 * intersection >= percent * union."""
    signed = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    kept = landed(mapped(signed.select("a", "b", "sig_a", "sig_b"), _pruned(least_matches(percent / 100)), "a long, b long"), "survivors")
    ids = kept.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = mapped(docs.join(landed(ids, "survivor-ids"), "doc_id", "left_semi"), _sets, "id long, shingles array<long>").groupBy("id").agg(F.min("shingles").alias("shingles"))
    sets = landed(sets, "sets")
    full = kept.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    counted = full.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("total"))
    return landed(counted.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links, kept) of every row of docs.

    class_id: the smallest doc_id with the same shingle set. n_links: links of the class
    found on the way; components are complete, pairs inside one component need not all be listed.
    """
    docs = keyed(docs, text, key)
    prints = landed(mapped(docs, _fingerprints, "doc_id long, n long, set_key binary, sig binary"), "prints")
    some = prints.filter("n > 0 AND doc_id IS NOT NULL")
    classes = landed(some.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n")), "classes")
    reps = landed(some.join(classes.select("set_key", F.col("class_id").alias("doc_id")), ["set_key", "doc_id"], "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct("set_key", "n", "sig")).alias("x")).select("id", "x.n", "x.sig"), "reps")

    bands = mapped(reps, _band_rows, "band long, id long, n long")
    hubs = bands.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    near_size = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    crowded = landed(bands.join(hubs, "band").select("band", "id", "n", "hub"), "crowded")
    first = crowded.filter(F.col("id") != F.col("hub.id")).filter(near_size(F.col("n"), F.col("hub.n"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(first, reps, docs, percent)
    linked = components(links)

    member = crowded.join(linked, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))
    split = member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").select("band", "size")
    torn = landed(member.join(split, "band"), "torn")
    narrow = torn.filter(F.col("size") <= PAIRED)
    left, right = narrow.alias("l"), narrow.alias("r")
    across = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.id") < F.col("r.id")) & (F.col("l.component") != F.col("r.component")) & near_size(F.col("l.n"), F.col("r.n")))
    close, prefix, patterns = _around_centers(landed(torn.filter(F.col("size") > PAIRED), "wide"), docs, percent)
    alone = prefix.withColumns({"low": F.col("component"), "high": F.col("component")})
    pairs = across.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).union(close).union(_meetings(alone, percent, hubs=True))
    second = landed(pairs.distinct().join(first, ["a", "b"], "left_anti"), "second-pairs")
    links = links.union(_verified(second, reps, docs, percent))
    linked = components(links)

    # What the hubs have not joined.
    links, linked = _by_patterns(prefix, patterns, linked, links, lambda pairs: _verified(pairs, reps, docs, percent), percent)

    counts = links.distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_class = classes.join(linked.withColumnRenamed("id", "class_id"), "class_id", "left").join(counts.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = prints.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; of rows repeated whole, one.

    Rows without doc_id stay. Rows that share a doc_id and differ stay or go together.
    """
    told = lambda: near_duplicates(docs, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).filter("rows > 1 OR NOT kept")
    found = settled(docs.sparkSession, "dropped-or-repeated", told)
    # Few ids come more than once, so only their rows are compared as a whole.
    repeated = docs.join(found.filter("kept").select("doc_id"), "doc_id", "left_semi").withColumn(_WHOLE, F.xxhash64(*[F.col(quoted(c)) for c in docs.columns])).dropDuplicates(["doc_id", _WHOLE]).drop(_WHOLE)
    return docs.join(found.select("doc_id"), "doc_id", "left_anti").unionByName(repeated.select(*[F.col(quoted(c)) for c in docs.columns]))


_WHOLE = "hash of the whole row"
