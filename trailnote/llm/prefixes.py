"""Conversation prefix trie: which beginnings conversations share, and what sharing them saves.

A node is a distinct sequence of first turns; the node of no turns is the root. A conversation
owns a node if no smaller conversation begins with it. Owning goes on: who owns a depth owns
all deeper ones. So each conversation's nodes are one chain, from its first owned depth to its
end, and the tree is a tree of chains.

1. A turn is told by the MD5 of role and text; texts go no further. A prefix digest is the sum of
   its turns' hashes, each taken with its depth: two 63-bit numbers. Sums need no order, so they
   are taken in blocks of depths, and a conversation with a third of all turns spreads over as
   many tasks as it has blocks.
2. Prefix-digest minima: the smallest conversation, the number of members and the last text's bytes of
   each digest, summed before the shuffle.
3. First owned depths by binary search: in each round all conversations look one depth up in
   the minima. Rounds are the logarithm of the longest conversation.
4. Chains are summed bottom-up along the chain tree, doubling the distance in each round, then
   along each chain in blocks of depths.

Defined cases: rows without conv_id are left out. Null role or text is empty. Rows of one turn
number are ordered by the MD5 of role and text, repeated rows are turns of their own. A table
without conversations has no nodes, not even the root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailnote.llm.common import landed, mapped
from trailnote.operators.ranges import numbered

#: Depths that one window task holds of a conversation, and conversations whose names are one piece of a digest.
BLOCK, NAMES = 1024, 4096


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place from 1, said, bytes): said tells role and text, bytes is the text's length in UTF-8."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    told = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t))
    told = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(told).alias("said"), F.octet_length(t).cast("long").alias("bytes"))
    return landed(numbered(told.filter("conv_id IS NOT NULL"), ["conv_id"], ["turn", "said"]).drop("turn"), "turns")


def rebuilt(placed: DataFrame, of: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, depth from 1, said, bytes): each conversation with its first turns taken from another.

    of: the other conversation; head: how many turns, at most most (a small bound). What
    conversations give is at most most turns each, so the join by giver has small groups.
    """
    sizes = landed(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    plan = sizes.select("conv_id", "n", of.alias("of"), head.cast("long").alias("head"))
    given = plan.join(sizes.select(F.col("conv_id").alias("of"), F.col("n").alias("of_n")), "of", "left")
    given = landed(given.select("conv_id", "n", "of", "head", F.least("head", F.coalesce("of_n", F.lit(0))).alias("got")), "givers")
    first = placed.filter(F.col("place") <= most).select(F.col("conv_id").alias("of"), F.col("place").alias("depth"), "said", "bytes")
    heads = given.filter("got > 0").select("conv_id", "of", "got").join(first, "of").filter("depth <= got")
    tails = placed.join(given.filter("n > head").select("conv_id", "head", "got"), "conv_id").filter("place > head").withColumn("depth", F.col("place") - F.col("head") + F.col("got"))
    starts = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("bytes"))
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), "said", "bytes"]
    return starts.union(heads.select(*columns)).union(tails.select(*columns))


def _numbers(said: Column, depth: Column) -> list[Column]:
    """Two numbers under 2**32 and two under 2**31 from the MD5 of a turn and its depth; the start's are 0."""
    told = F.md5(F.concat(said, F.lit(b":"), depth.cast("string").cast("binary")))
    part = lambda at: F.conv(F.substring(told, at, 8), 16, 10).cast("long")
    return [F.when(depth > 0, part(1 + 8 * k) % (1 << (31 if k % 2 else 32))).otherwise(0).alias(f"s{k}") for k in range(4)]


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, x, y): x and y tell the first depth turns, up to a chance of 2**-126 for two of one depth."""
    names = [f"s{k}" for k in range(4)]
    rows = turns.select("conv_id", "depth", "bytes", F.floor(F.col("depth") / BLOCK).alias("block"), *_numbers(F.col("said"), F.col("depth")))
    rows = landed(rows, "turn-hashes")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for every block but a conversation's first, which nothing stands before.
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in names])
    before = blocks.select("conv_id", "block", *[F.sum(s).over(along).alias(f"{s}_before") for s in names]).filter("block > 0")
    summed = rows.select("conv_id", "depth", "block", "bytes", *[F.sum(s).over(inside).alias(s) for s in names]).join(before, ["conv_id", "block"], "left")
    whole = lambda k: (F.col(f"s{k}") + F.coalesce(f"s{k}_before", F.lit(0))) % (1 << (31 if k % 2 else 32))
    pair = lambda k: (whole(k + 1) * (1 << 32) + whole(k))
    return summed.select("conv_id", "depth", "bytes", pair(0).alias("x"), pair(2).alias("y"))


def first_owned(prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, n, first, up): the smallest depth that the conversation owns, n + 1 if none; and who owns the depth before."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("depth").alias("n"))
    found = landed(sizes.select("conv_id", "n", F.lit(0).cast("long").alias("low"), (F.col("n") + 1).alias("high")), "search")
    owner = minima.select("depth", "x", "y", "owner")
    keys = prefixes.select("conv_id", "depth", "x", "y")
    longest = found.agg(F.max("high")).first()[0]
    for _ in range((longest or 0).bit_length()):
        asked = found.filter("low < high").select("conv_id", F.expr("(low + high) div 2").alias("depth"))
        said = asked.join(keys, ["conv_id", "depth"]).join(owner, ["depth", "x", "y"]).select("conv_id", F.col("depth").alias("mid"), (F.col("owner") == F.col("conv_id")).alias("own"))
        met = found.join(said, "conv_id", "left")
        found = landed(met.select("conv_id", "n", F.when(~F.col("own"), F.col("mid") + 1).otherwise(F.col("low")).alias("low"), F.when(F.col("own"), F.col("mid")).otherwise(F.col("high")).alias("high")), "search")
    found = found.select("conv_id", "n", F.col("low").alias("first"))
    above = found.select("conv_id", (F.col("first") - 1).alias("depth")).join(keys, ["conv_id", "depth"]).join(owner, ["depth", "x", "y"]).select("conv_id", F.col("owner").alias("up"))
    return landed(found.join(above, "conv_id", "left"), "chains")


def _chain_totals(own: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of each chain's whole subtree, from own (conv_id, up, leaves, saved); up is null for the root's.

    Each round adds what the chains at the distance of this round have gathered, then doubles it.
    """
    now = landed(own, "chain-sums")
    while not now.filter("up IS NOT NULL").isEmpty():
        more = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = now.select(F.col("conv_id").alias("up"), F.col("up").alias("far"))
        met = now.join(far, "up", "left").join(more, "conv_id", "left")
        now = landed(met.select("conv_id", F.col("far").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "chain-sums")
    return now.drop("up")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, piece, names) in order: only one digest is open at a time."""
    key, digest = None, None
    out = lambda: pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "ends_sha256": digest.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
    for batch in batches:
        for conv, depth, names in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, depth) == key:
                digest.update(b",")
            else:
                if key:
                    yield out()
                key, digest = (conv, depth), hashlib.sha256()
            digest.update(names.encode())
    if key:
        yield out()


def ends(chains: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of each node at which conversations end.

    Names are joined in pieces of at most NAMES conversations. A node of several pieces has
    them hashed one after the other by one task, which holds one piece at a time: a SHA-256 has
    no parallel form.
    """
    at = chains.select(F.col("conv_id").alias("name"), F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n").alias("depth"))
    pieces = at.groupBy("conv_id", "depth", F.floor(F.col("name") / NAMES).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("name")).cast("array<string>"), ",").alias("names"))
    pieces = landed(pieces, "ends")
    many = landed(pieces.groupBy("conv_id", "depth").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("conv_id", "depth"), "long-ends")
    short = pieces.join(many, ["conv_id", "depth"], "left_anti").select("conv_id", "depth", F.sha2("names", 256).alias("ends_sha256"))
    streamed = pieces.join(many, ["conv_id", "depth"], "left_semi").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return short.union(mapped(streamed, _streamed, "conv_id long, depth long, ends_sha256 string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the conversations turns (conv_id, depth, said, bytes; each with a row of depth 0):

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256 of the names of the conversations that end here.
    """
    prefixes = landed(digests(turns), "prefixes")
    minima = landed(prefixes.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes")), "minima")
    chains = first_owned(prefixes, minima)
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    owners = chains.filter("first <= n")
    hung = owners.filter("up IS NOT NULL").select("conv_id", "up", (F.col("first") - 1).alias("depth"))
    at_end = hung.groupBy(F.col("up").alias("conv_id"), F.col("depth").alias("n")).agg(F.count("*").alias("hanging"))
    saved = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    own = owners.join(at_end, ["conv_id", "n"], "left").join(saved, "conv_id")
    own = landed(own.select("conv_id", "up", F.when(F.col("hanging").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved"), "chain-own")
    totals = _chain_totals(own)

    # What is known of single nodes: where a chain begins, where it ends, what hangs there, who ends there.
    fields = {"begins": "boolean", "parent": "long", "last": "boolean", "hanging": "long", "leaves": "long", "saved_below": "long", "ends_sha256": "string"}

    def known(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("conv_id", "depth", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()])

    below = hung.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parts = [
        known(owners.withColumn("depth", F.col("first")), begins=F.lit(True), parent=F.col("up")),
        known(owners.withColumn("depth", F.col("n")), last=F.lit(True)),
        known(below, hanging=F.col("hanging"), leaves=F.col("leaves"), saved_below=F.col("saved")),
        known(ends(chains), ends_sha256=F.col("ends_sha256")),
    ]
    facts = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in fields])
    met = nodes.join(facts, ["conv_id", "depth"], "left").withColumn("block", F.floor(F.col("depth") / BLOCK))
    leaf = F.col("last").isNotNull() & F.col("hanging").isNull()
    met = met.select(
        "conv_id",
        "depth",
        "block",
        F.when(F.col("begins"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("hanging", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1)).alias("n_children"),
        (F.when(leaf, 1).otherwise(0) + F.coalesce("leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    met = landed(met, "nodes")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = met.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select("conv_id", "block", F.sum("l").over(along).alias("l"), F.sum("s").over(along).alias("s")).filter("l IS NOT NULL")
    summed = met.select("*", F.sum("leaves").over(inside).alias("n_leaves"), F.sum("saved").over(inside).alias("saved_tokens")).join(after, ["conv_id", "block"], "left")
    return summed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        "ends_sha256",
    )
