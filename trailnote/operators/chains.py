"""Markov chains as edge tables: absorption, expected steps, stationary distributions, periods, mixing.

A chain is a table (state, next_state, n) of counted transitions, as transition_counts gives it;
the vocabulary of states may be as large as the table. Vectors over states are tables with one row
a state. A product of matrix and vector is a join along the edges and a sum; nothing ever has
more rows than there are edges, and only a fixed number of sums reaches the driver.
Null states are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.operators.trajectory import PLACES
from trailnote.sources.tables import landed, spread

#: Earlier vectors that a solver's step is mixed from, and plain steps between two mixings.
MEMORY, STEPS = 8, 6


def probabilities(counts: DataFrame) -> DataFrame:
    """(state, next_state, q): counts over all that leave the state, unrounded."""
    known = counts.filter("state IS NOT NULL AND next_state IS NOT NULL AND n > 0").groupBy("state", "next_state").agg(F.sum("n").cast("double").alias("n"))
    total = known.groupBy("state").agg(F.sum("n").alias("total"))
    return landed(known.join(spread(total), "state").select("state", "next_state", (F.col("n") / F.col("total")).alias("q")), "chain")


def states_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("state", "next_state")).alias("state")).distinct()


def solved(moves: DataFrame, rows: DataFrame, tolerance: float = 1e-11, most: int = 400) -> DataFrame:
    """(state, x) with x = b + sum of q * x(other) over moves (state, other, q), from rows (state, b, x).

    Each round is STEPS Jacobi steps, of which the mean of the last two counts: after a fixed number of moves alone, a chain
    whose period divides it keeps any split between the parts of its cycle, right or wrong. Rounds are mixed with the MEMORY
    rounds before so that the residual is least (Anderson's mixing; on a linear system as good as restarted GMRES). A row keeps its own
    earlier values, so mixing needs no join; what the driver gets are sums of products with the residuals
    before, MEMORY + 2 numbers a round. Starting from zero, states that nothing in b can be reached from stay zero, so
    closed classes do no harm. Stops when the residuals add up to at most tolerance.
    """
    none = F.array().cast("array<double>")
    now = landed(rows.select("state", "b", F.col("x").cast("double").alias("x"), none.alias("xs"), none.alias("fs")), "solver")
    gram = np.zeros((0, 0))
    for _ in range(most):
        after = now.withColumn("y", F.col("x"))
        for i in range(STEPS):
            heard = moves.join(spread(after.select(F.col("state").alias("other"), F.col("y").alias("y_other"))), "other").groupBy("state").agg(F.sum(F.col("q") * F.col("y_other")).alias("g"))
            moved = F.col("b") + F.coalesce("g", F.lit(0.0))
            after = after.join(spread(heard), "state", "left").withColumn("y", moved if i < STEPS - 1 else (F.col("y") + moved) / 2).drop("g")
        now = landed(after.select("state", "b", "x", (F.col("y") - F.col("x")).alias("f"), "xs", "fs"), "solver")
        held = len(gram)
        got = list(now.selectExpr("sum(abs(f)) AS far", "sum(f * f) AS own", *[f"sum(f * fs[{i}]) AS s{i}" for i in range(held)]).first())
        if (got[0] or 0.0) <= tolerance:
            return now.select("state", "x")
        # Products of the latest residual and those before, newest first; differences follow from them.
        gram = np.block([[np.array([[got[1]]]), np.array([got[2:]])], [np.array([got[2:]]).T, gram]]) if held else np.array([[got[1]]])
        step = "x + f"
        if held:
            gap = gram[0, 0] - gram[0, 1:, None] - gram[0, None, 1:] + gram[1:, 1:]
            scale = np.sqrt(np.maximum(np.diag(gap), 1e-300))
            mix = np.linalg.lstsq(gap / np.outer(scale, scale), (gram[0, 0] - gram[0, 1:]) / scale, rcond=1e-12)[0] / scale
            step += "".join(f" - ({float(m)!r}D) * (x - xs[{i}] + f - fs[{i}])" for i, m in enumerate(mix))
        gram = gram[:MEMORY, :MEMORY]
        now = now.selectExpr("state", "b", f"{step} AS x", f"slice(concat(array(x), xs), 1, {MEMORY}) AS xs", f"slice(concat(array(f), fs), 1, {MEMORY}) AS fs")
    raise RuntimeError(f"no solution within {tolerance} after {most} rounds")


def absorption(counts: DataFrame, goals: Sequence[str], failures: Sequence[str], key: str = "state") -> DataFrame:
    """(state, p_success, steps): Pr(goal before failure) from each state, and the expected steps to it given that; null where it never is.

    key: the part of the state that goals and failures name (state itself, or a field of a struct).
    h = Q h + b with b the way into the goals, and m = Q m + h for the steps of the successful: steps = m / h.
    """
    edges = probabilities(counts)
    field = lambda c: F.col(c + key.removeprefix("state"))
    goal, end = lambda c: field(c).isin(*goals), lambda c: field(c).isin(*goals, *failures)
    inner = edges.filter(~end("state"))
    states = landed(states_of(edges), "chain-states")
    # Staying is solved for at once: x = (b + moves to others) / (1 - staying); who never leaves gets nothing.
    stays = F.coalesce(F.sum(F.when(F.col("state") == F.col("next_state"), F.col("q"))), F.lit(0.0))
    into = inner.groupBy("state").agg(F.sum(F.when(goal("next_state"), F.col("q")).otherwise(0.0)).alias("b"), F.when(stays < 1, 1 / (1 - stays)).otherwise(1.0).alias("scale"))
    into = landed(into, "chain-into")
    moves = inner.filter(~end("next_state") & (F.col("state") != F.col("next_state"))).join(spread(into), "state")
    moves = landed(moves.select("state", F.col("next_state").alias("other"), (F.col("q") * F.col("scale")).alias("q")), "chain-moves")
    scaled = lambda rows, b: rows.join(spread(into.select("state", "scale")), "state", "left").select("state", (F.col(b) * F.coalesce("scale", F.lit(1.0))).alias("b"), F.lit(0.0).alias("x"))
    first = states.filter(~end("state")).join(spread(into.select("state", "b")), "state", "left").select("state", F.coalesce("b", F.lit(0.0)).alias("b"))
    h = landed(solved(moves, scaled(first, "b")), "chain-h")
    m = solved(moves, scaled(h, "x"))
    found = h.withColumnRenamed("x", "h").join(spread(m.withColumnRenamed("x", "m")), "state")
    # Below the solver's tolerance a probability is none.
    sure = F.when(F.col("h") > 1e-9, F.col("m") / F.col("h"))
    inside = found.select("state", F.round("h", PLACES).alias("p_success"), F.round(sure, PLACES).alias("steps"))
    outside = states.filter(end("state")).select("state", F.when(goal("state"), 1.0).otherwise(0.0).alias("p_success"), F.when(goal("state"), F.lit(0.0)).alias("steps"))
    return inside.union(outside)


def periods(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, period) of each class (state, class_id) that has a move inside; 1 is aperiodic.

    Places in the cycle are differences along any way, forth or back: components are joined along
    edges with the difference of their roots, halving their number in each round; then the
    period is the greatest common divisor of what the edges differ by, found by remainders.
    """
    of = lambda side: classes.select(F.col("state").alias(side), F.col("class_id").alias(f"{side}_class"))
    inner = edges.select("state", "next_state").join(of("state"), "state").join(of("next_state"), "next_state").filter("state_class = next_state_class")
    inner = landed(inner.select(F.col("state_class").alias("class_id"), "state", "next_state").distinct(), "class-edges")
    at = landed(states_of(inner).select("state", F.col("state").alias("root"), F.lit(0).cast("long").alias("place")), "places")
    while True:
        a, b = (at.select(F.col("state").alias(c), F.col("root").alias(f"{c}_root"), F.col("place").alias(f"{c}_place")) for c in ("state", "next_state"))
        seen = inner.join(a, "state").join(b, "next_state")
        # place(next) = place(state) + 1; the larger root is placed by the smaller one.
        gap = F.col("state_place") + 1 - F.col("next_state_place")
        hooks = seen.filter("state_root <> next_state_root").select(
            F.greatest("state_root", "next_state_root").alias("root"), F.struct(F.least("state_root", "next_state_root").alias("to"), F.when(F.col("state_root") < F.col("next_state_root"), gap).otherwise(-gap).alias("by")).alias("hook")
        )
        hooks = landed(hooks.groupBy("root").agg(F.min("hook").alias("hook")).select("root", "hook.to", "hook.by"), "hooks")
        if hooks.isEmpty():
            break
        while True:
            far = hooks.select(F.col("root").alias("to"), F.col("to").alias("far"), F.col("by").alias("more"))
            hooks = landed(hooks.join(far, "to", "left").select("root", F.coalesce("far", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"), F.col("far").isNotNull().alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        at = landed(at.join(hooks.drop("moved"), "root", "left").select("state", F.coalesce("to", "root").alias("root"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place")), "places")
    rest = landed(seen.select("class_id", F.abs(gap).alias("gap")).distinct(), "gaps")
    while True:
        # A class without any difference has no cycle, which a closed class with a move cannot be.
        least = rest.groupBy("class_id").agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("period"))
        left = landed(rest.join(least, "class_id").filter("gap % period > 0").select("class_id", F.expr("gap % period").alias("gap")).distinct(), "gaps")
        if left.isEmpty():
            return least
        rest = left.union(least).distinct()


def stationary(counts: DataFrame, classes: DataFrame, tolerance: float = 1e-11) -> DataFrame:
    """(class_id, state, p, period) of the states of each closed class: the distribution that a move leaves as it is.

    classes: (state, class_id, closed). The solver starts from equal shares and keeps their sum; it also ends
    for periodic classes, where moving alone would swing for ever. A closed state without
    moves has itself for a distribution, and no period.
    """
    edges = probabilities(counts)
    closed = landed(classes.filter("closed").select("state", "class_id"), "closed-classes")
    size = closed.groupBy("class_id").agg(F.count("*").alias("size"))
    moves = landed(edges.join(spread(closed), "state", "left_semi").select(F.col("next_state").alias("state"), F.col("state").alias("other"), "q"), "chain-moves")
    stay = closed.join(spread(edges.select("state").distinct()), "state", "left_anti").select("state", F.col("state").alias("other"), F.lit(1.0).alias("q"))
    start = closed.join(spread(size), "class_id").select("state", F.lit(0.0).alias("b"), (1.0 / F.col("size")).alias("x"))
    found = solved(landed(moves.union(stay), "chain-moves"), start, tolerance)
    met = closed.join(spread(found), "state").join(spread(periods(edges, closed)), "class_id", "left")
    return met.select("class_id", "state", F.round("x", PLACES).alias("p"), "period")


def mixing_steps(counts: DataFrame, goal: DataFrame, start: DataFrame, within: float = 0.25, most: int = 200) -> int | None:
    """The fewest moves after which the distribution from start (state, p) is within that total variation distance of goal (state, p); None if most are not enough.

    A periodic chain never gets there. One number a round reaches the driver.
    """
    edges = probabilities(counts)
    now = start.select("state", F.col("p").cast("double").alias("p"))
    for i in range(most + 1):
        apart = now.select("state", F.col("p").alias("a")).join(goal.select("state", F.col("p").alias("b")), "state", "full").agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2).alias("d")).first()[0]
        if (apart or 0.0) <= within:
            return i
        now = now.join(edges, "state").groupBy(F.col("next_state").alias("state")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        now = landed(now, "mixing")
    return None
