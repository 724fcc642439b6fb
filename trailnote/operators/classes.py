"""Classes and communities of a transition graph, by labels that travel along edges.

Every table has at most a row for each edge or state; no closure is written. What one
round costs is a join along the edges and a sum that is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.operators.trajectory import PLACES, ratio
from trailnote.sources.tables import landed


def least_reaching(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(state, label): the least label of all states that reach the state along edges (state, next_state), its own one included.

    labels: (state, label). One move a round would need as many rounds as the longest way; so each state
    also keeps one way back, along the neighbour that gave it its label, which doubles in
    length while that lowers labels: a ring of 100,000 takes some 20 steps.
    """
    now = landed(labels.select("state", "label", F.col("state").alias("back")), "labels")
    while True:
        heard = edges.join(now.select("state", "label"), "state").groupBy(F.col("next_state").alias("state")).agg(F.min(F.struct("label", F.col("state").alias("back"))).alias("heard"))
        lower = F.coalesce(F.col("heard.label") < F.col("label"), F.lit(False))
        met = now.join(heard, "state", "left")
        now = landed(met.select("state", F.when(lower, F.col("heard.label")).otherwise(F.col("label")).alias("label"), F.coalesce("heard.back", "state").alias("back"), lower.alias("moved")), "labels")
        if now.filter("moved").isEmpty():
            return now.select("state", "label")
        while not now.filter("moved").isEmpty():
            far = now.select(F.col("state").alias("back"), F.col("label").alias("far_label"), F.col("back").alias("far_back"))
            lower = F.col("far_label") < F.col("label")
            now = landed(now.join(far, "back").select("state", F.least("label", "far_label").alias("label"), F.col("far_back").alias("back"), lower.alias("moved")), "labels")


def strong_classes(edges: DataFrame) -> DataFrame:
    """(state, class_id, class_size): states that reach each other are a class, named by its smallest.

    Trimming takes states that nothing left enters or leaves: they are alone. Of the rest each
    takes the least label that reaches it, and going back along edges of one label the states that
    reach its owner again are a class. Labels are hashes, so long ways break up in the middle and
    the rounds grow with the logarithm of the states, not with their number.
    """
    states = landed(edges.select(F.explode(F.array("state", "next_state")).alias("state")).filter("state IS NOT NULL").distinct(), "states")
    left = landed(edges.filter("state <> next_state").select("state", "next_state").distinct(), "class-edges")
    found = []
    while not left.isEmpty():
        # Two trimmings a round; longer tails fall to the labels.
        for _ in range(2):
            both = left.select("state").distinct().join(left.select(F.col("next_state").alias("state")).distinct(), "state", "left_semi")
            left = left.join(both, "state", "left_semi").join(both.select(F.col("state").alias("next_state")), "next_state", "left_semi")
        left = landed(left.select("state", "next_state"), "class-edges")
        labels = left.select(F.explode(F.array("state", "next_state")).alias("state")).distinct().select("state", F.struct(F.xxhash64("state", F.lit(len(found))).alias("h"), F.col("state").alias("of")).alias("label"))
        forth = least_reaching(labels, left)
        ends = left.join(forth.withColumnRenamed("label", "a"), "state").join(forth.select(F.col("state").alias("next_state"), F.col("label").alias("b")), "next_state").filter("a = b")
        ends = landed(ends.select("state", "next_state"), "class-edges")
        backward = least_reaching(forth.select("state", F.struct(F.col("label.h").alias("h"), F.col("label.of").alias("of"), F.when(F.col("label.of").eqNullSafe(F.col("state")), 0).otherwise(1).alias("not_owner")).alias("label")), ends.select(F.col("next_state").alias("state"), F.col("state").alias("next_state")))
        # All states of one label carry it; only the owner's has not_owner = 0, and it travels back along edges of that label.
        own = landed(backward.filter("label.not_owner = 0").select("state", F.col("label.of").alias("owner")), "classes-found")
        found.append(own)
        left = landed(ends.join(own, "state", "left_anti").join(own.select(F.col("state").alias("next_state")), "next_state", "left_anti").select("state", "next_state"), "class-edges")
    owners = states.select("state", F.col("state").alias("owner")).filter(F.lit(False))
    for own in found:
        owners = owners.union(own.select("state", "owner"))
    owners = states.join(owners, "state", "left").select("state", F.coalesce("owner", "state").alias("owner"))
    named = owners.groupBy("owner").agg(F.min("state").alias("class_id"), F.count("*").alias("class_size"))
    return landed(owners.join(named, "owner").select("state", "class_id", "class_size"), "classes")


def recurrent_classes(edges: DataFrame, goals: Sequence[str] = ()) -> DataFrame:
    """(state, class_id, class_size, closed, stuck) of each state of edges.

    A class is closed if no edge leaves it, and stuck if it is closed and has no goal.
    """
    named = strong_classes(edges)
    there = named.select(F.col("state").alias("next_state"), F.col("class_id").alias("next_class"))
    leaves = edges.join(named, "state").join(there, "next_state").groupBy("class_id").agg(F.max(F.col("class_id") != F.col("next_class")).alias("leaves"))
    goal = named.groupBy("class_id").agg(F.max(F.col("state").isin(*goals) if goals else F.lit(False)).alias("goal"))
    met = named.join(leaves, "class_id", "left").join(goal, "class_id").withColumn("closed", ~F.coalesce("leaves", F.lit(False)))
    return met.select("state", "class_id", "class_size", "closed", (F.col("closed") & ~F.col("goal")).alias("stuck"))


def undirected(counts: DataFrame) -> DataFrame:
    """(state, other, w): both directions of each pair with the transitions between them; a state's own are left out."""
    w = counts.filter("state IS NOT NULL AND next_state IS NOT NULL AND state <> next_state")
    both = w.select("state", F.col("next_state").alias("other"), "n").union(w.select("next_state", "state", "n"))
    return landed(both.groupBy("state", "other").agg(F.sum("n").alias("w")), "undirected")


def communities(counts: DataFrame, rounds: int = 12) -> DataFrame:
    """(state, community) by label propagation on the weighted graph of counts (state, next_state, n).

    In each round half the states, by a hash of state and round, take the label with the greatest weight
    among their neighbours; they keep their own if it is among the greatest, else the smallest counts. Half at
    a time, so two states never swap for ever. Ends after two rounds without change, or after rounds.
    """
    links = undirected(counts)
    states = counts.select(F.explode(F.array("state", "next_state")).alias("state")).filter("state IS NOT NULL").distinct()
    now, quiet = landed(states.select("state", F.col("state").alias("community")), "communities"), 0
    for r in range(rounds):
        turn = (F.substring(F.md5(F.concat(F.col("state").cast("string"), F.lit(f":{r // 2}"))), 1, 1) < "8") == F.lit(r % 2 == 0)
        weights = links.filter(turn).join(now.select(F.col("state").alias("other"), "community"), "other").groupBy("state", "community").agg(F.sum("w").alias("w"))
        best = weights.join(now.select("state", F.col("community").alias("own")), "state").groupBy("state").agg(F.min(F.struct((-F.col("w")).alias("less"), (F.col("community") != F.col("own")).alias("new"), "community")).alias("best"))
        met = now.join(best, "state", "left").select("state", F.coalesce("best.community", "community").alias("community"), F.coalesce(F.col("best.community") != F.col("community"), F.lit(False)).alias("moved"))
        now = landed(met, "communities")
        quiet = quiet + 1 if now.filter("moved").isEmpty() else 0
        now = now.select("state", "community")
        if quiet >= 2 and r % 2:
            break
    return now


def community_cuts(counts: DataFrame, found: DataFrame) -> DataFrame:
    """(community, n_states, volume, inside, cut, conductance, modularity) of each community of found (state, community).

    volume: the weight at its states; inside: of which on edges within; cut: the rest. conductance = cut
    over the lesser volume of it and all others; modularity: its term of the graph's.
    """
    links = undirected(counts)
    here, there = found.select("state", "community"), found.select(F.col("state").alias("other"), F.col("community").alias("to"))
    sums = links.join(here, "state").join(there, "other").groupBy("community").agg(F.sum("w").alias("volume"), F.sum(F.when(F.col("community") == F.col("to"), F.col("w")).otherwise(0)).alias("inside"))
    sizes = found.groupBy("community").agg(F.count("*").alias("n_states"))
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("total"))
    met = sizes.join(sums, "community", "left").select("community", "n_states", F.coalesce("volume", F.lit(0)).alias("volume"), F.coalesce("inside", F.lit(0)).alias("inside")).join(F.broadcast(total))
    share = F.try_divide(F.col("inside").cast("double"), F.col("total")) - F.pow(F.try_divide(F.col("volume").cast("double"), F.col("total")), 2)
    return met.select("community", "n_states", "volume", "inside", (F.col("volume") - F.col("inside")).alias("cut"), ratio(F.col("volume") - F.col("inside"), F.least(F.col("volume"), F.col("total") - F.col("volume"))).alias("conductance"), F.round(share, PLACES).alias("modularity"))


def bridges(counts: DataFrame, found: DataFrame) -> DataFrame:
    """(state, next_state, community, to_community, n, p) of the transitions between communities; p is their share of all that leave the state."""
    known = counts.filter("state IS NOT NULL AND next_state IS NOT NULL")
    total = known.groupBy("state").agg(F.sum("n").alias("total"))
    met = known.join(found, "state").join(found.select(F.col("state").alias("next_state"), F.col("community").alias("to_community")), "next_state").filter("community <> to_community").join(total, "state")
    return met.select("state", "next_state", "community", "to_community", "n", ratio(F.col("n"), F.col("total")).alias("p"))
