"""State-transition statistics of trajectories.

A trajectory table has one row per step: run_id, step, state, next_state and, where known,
action, cost and variant. States are names from a vocabulary, so everything keyed by states is
small beside the steps, which only ever meet in partial aggregates. Ordering a run needs its
rows together; ``indexed`` orders them bucket by bucket of time, so that one run with a third
of all rows spreads over as many tasks as it has buckets.

Never-hit sets count as infinity: such runs stay in every denominator and are reported beside
conditional means. Null states are states of their own and never goals or failures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailnote.sources.tables import landed

#: Decimal places of every ratio that leaves this module.
PLACES = 6


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), PLACES)


def indexed(rows: DataFrame, run: str, order: Sequence[str], state: str, bucket: Column, keep: Sequence[str] = ()) -> DataFrame:
    """rows as a trajectory: run_id, step (from 0), state, next_state, and the columns keep.

    bucket must not fall as order rises (a day of the time, say). Steps are numbered within a
    bucket; one row per run and bucket then tells where the bucket's numbers begin and which
    state follows its last.
    """
    part = rows.select(F.col(run).alias("run_id"), F.col(state).alias("state"), bucket.alias("bucket"), F.struct(*[F.col(c) for c in order]).alias("at"), *[F.col(c) for c in keep])
    inside = Window.partitionBy("run_id", "bucket").orderBy("at")
    near = part.select("*", F.row_number().over(inside).alias("place"), F.lead(F.struct("state")).over(inside).alias("after"))
    heads = part.groupBy("run_id", "bucket").agg(F.count("*").alias("n"), F.min_by(F.struct("state"), "at").alias("first"))
    along = Window.partitionBy("run_id").orderBy("bucket")
    heads = heads.select(F.col("run_id").alias("h_run"), F.col("bucket").alias("h_bucket"), (F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"), F.lead("first").over(along).alias("then"))
    met = near.join(heads, F.col("run_id").eqNullSafe(F.col("h_run")) & F.col("bucket").eqNullSafe(F.col("h_bucket")))
    last = F.coalesce("after", "then")
    return met.select("run_id", (F.col("before") + F.col("place") - 1).cast("long").alias("step"), "state", last["state"].alias("next_state"), last.isNotNull().alias("has_next"), *keep)


def transition_counts(traj: DataFrame) -> DataFrame:
    """(state, next_state, n): terminal steps have no next state and do not count."""
    return traj.filter("has_next").groupBy("state", "next_state").agg(F.count("*").alias("n"))


def shares(counts: DataFrame, given: Sequence[str], n: str = "n", name: str = "p") -> DataFrame:
    """counts with name = n / sum of n over rows equal in given. counts is a small aggregate."""
    return counts.withColumn(name, ratio(F.col(n), F.sum(n).over(Window.partitionBy(*given))))


def transition_matrix(traj: DataFrame) -> DataFrame:
    """(state, next_state, n, p) in long form; the p of one state add up to 1."""
    return shares(transition_counts(traj), ["state"])


def policy(traj: DataFrame) -> DataFrame:
    """(state, action, n, p): how often each action is taken in a state, over steps that have a next one."""
    return shares(traj.filter("has_next").groupBy("state", "action").agg(F.count("*").alias("n")), ["state"])


def action_transitions(traj: DataFrame) -> DataFrame:
    """(state, action, next_state, n, p): where an action taken in a state leads."""
    return shares(traj.filter("has_next").groupBy("state", "action", "next_state").agg(F.count("*").alias("n")), ["state", "action"])


def induced_chain(policy: DataFrame, moves: DataFrame) -> DataFrame:
    """(state, next_state, p): sum over actions of p(action | state) * p(next | state, action)."""
    part = lambda rows, given: rows.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(*given)))  # noqa: E731  unrounded
    a, b = part(policy, ["state"]).alias("a"), part(moves, ["state", "action"]).alias("b")
    met = a.join(b, F.col("a.state").eqNullSafe(F.col("b.state")) & F.col("a.action").eqNullSafe(F.col("b.action")))
    return met.groupBy("a.state", "b.next_state").agg(F.round(F.sum(F.col("a.q") * F.col("b.q")), 4).alias("p"))


def masked_policy(policy: DataFrame, allowed: DataFrame) -> DataFrame:
    """(state, action, p, p_masked): the policy with actions outside allowed (state, action) removed and renormalised.

    Forbidden actions get 0; a state that keeps no action gets null throughout.
    """
    met = policy.join(allowed.select("state", "action").distinct().withColumn("ok", F.lit(True)), ["state", "action"], "left")
    mass = F.when(F.col("ok"), F.col("n")).otherwise(0)
    return met.select("state", "action", "p", ratio(mass, F.sum(mass).over(Window.partitionBy("state"))).alias("p_masked"))


def hitting_times(traj: DataFrame, goals: Sequence[str], failures: Sequence[str]) -> DataFrame:
    """(run_id, variant if any, n_steps, tau_g, tau_f): first step in either set, null for never."""
    keys = ["run_id", *(["variant"] if "variant" in traj.columns else [])]
    first = lambda names: F.min(F.when(F.col("state").isin(*names), F.col("step")))
    return traj.groupBy(*keys).agg(F.count("*").alias("n_steps"), first(goals).alias("tau_g"), first(failures).alias("tau_f"))


def succeeded() -> Column:
    """tau_g < tau_f with never as infinity."""
    return F.col("tau_g").isNotNull() & (F.col("tau_f").isNull() | (F.col("tau_g") < F.col("tau_f")))


def success_before_failure(taus: DataFrame) -> DataFrame:
    """One row: runs, successes, failures, censored and their shares."""
    ok, failed = succeeded(), F.col("tau_f").isNotNull() & ~succeeded()
    one = taus.agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.count_if(failed).alias("failures"), F.count_if(F.col("tau_g").isNull() & F.col("tau_f").isNull()).alias("censored"))
    return one.select("*", ratio(F.col("successes"), F.col("runs")).alias("p_success"))


def expected_hitting_time(taus: DataFrame) -> DataFrame:
    """Mean first step in the goals over successes, over all runs that hit, and how many runs never do."""
    return taus.agg(
        F.round(F.avg(F.when(succeeded(), F.col("tau_g"))), PLACES).alias("mean_given_success"),
        F.round(F.avg("tau_g"), PLACES).alias("mean_given_hit"),
        F.count_if(succeeded()).alias("successes"),
        F.count_if(F.col("tau_g").isNull()).alias("never_hit"),
    )


def expected_cost(traj: DataFrame) -> DataFrame:
    """Cost per run: mean, least and greatest of the sums. A null cost is none."""
    per = traj.groupBy("run_id").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return per.agg(F.count("*").alias("runs"), F.round(F.avg("cost"), 4).alias("mean_cost"), F.round(F.min("cost"), 4).alias("min_cost"), F.round(F.max("cost"), 4).alias("max_cost"))


def false_completion(claims: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Claims of completion by verdict pass / fail / uncertain (null: not verified), with the share of failed among decided ones."""
    v = F.col(verdict)
    out = claims.agg(F.count("*").alias("claims"), *[F.count_if(v == x).alias(x) for x in ("pass", "fail", "uncertain")], F.count_if(v.isNull()).alias("unverified"))
    return out.select("*", ratio(F.col("fail"), F.col("pass") + F.col("fail")).alias("false_rate"))


def loops(traj: DataFrame) -> DataFrame:
    """(run_id, n_steps, retries, n_revisited, max_visits): self-transitions, states visited again, most visits to one state.

    Visits are counted per run and state first, so a long run is summed in pieces.
    """
    visits = traj.groupBy("run_id", "state").agg(F.count("*").alias("visits"), F.count_if(F.col("has_next") & F.col("state").eqNullSafe(F.col("next_state"))).alias("again"))
    return visits.groupBy("run_id").agg(F.sum("visits").alias("n_steps"), F.sum("again").alias("retries"), F.count_if(F.col("visits") > 1).alias("n_revisited"), F.max("visits").alias("max_visits"))


def longest_streaks(traj: DataFrame, width: int = 10_000) -> DataFrame:
    """(run_id, streak, state): the longest unbroken stay in one state, the earliest of equals.

    A stay ends where the next state differs; the distance between such ends is its length.
    """
    ends = traj.filter(~F.col("has_next") | ~F.col("state").eqNullSafe(F.col("next_state"))).select("run_id", "step", "state")
    # The end before each end, bucket by bucket as in indexed().
    bucketed = ends.withColumn("bucket", F.floor(F.col("step") / width))
    before = F.lag("step").over(Window.partitionBy("run_id", "bucket").orderBy("step"))
    tails = bucketed.groupBy("run_id", "bucket").agg(F.max("step").alias("tail"))
    tails = tails.withColumn("earlier", F.lag("tail").over(Window.partitionBy("run_id").orderBy("bucket"))).drop("tail")
    met = bucketed.withColumn("before", before).join(tails, ["run_id", "bucket"])
    stays = met.select("run_id", "state", "step", (F.col("step") - F.coalesce("before", "earlier", F.lit(-1))).alias("streak"))
    return stays.groupBy("run_id").agg(F.max_by(F.struct("streak", "state"), F.struct("streak", -F.col("step"))).alias("x")).select("run_id", "x.streak", "x.state")


def absorbing(traj: DataFrame) -> DataFrame:
    """(state, visits, leaving): states seen that no transition leaves for another state."""
    seen = traj.groupBy("state").agg(F.count("*").alias("visits"), F.count_if(F.col("has_next") & ~F.col("state").eqNullSafe(F.col("next_state"))).alias("leaving"))
    return seen.withColumn("absorbing", F.col("leaving") == 0)


def bottlenecks(matrix: DataFrame, clusters: DataFrame, below: float) -> DataFrame:
    """Edges of matrix between different clusters (state, cluster) with p < below. clusters is a small lookup of states."""
    here = clusters.select("state", F.col("cluster").alias("from_cluster"))
    there = clusters.select(F.col("state").alias("next_state"), F.col("cluster").alias("to_cluster"))
    return matrix.join(here, "state").join(there, "next_state").filter((F.col("from_cluster") != F.col("to_cluster")) & (F.col("p") < below)).select("state", "next_state", "from_cluster", "to_cluster", "n", "p")


def escape_probability(counts: DataFrame, inside: Sequence[str]) -> DataFrame:
    """(state, n, escapes, p_escape) of each state of the set: the share of its transitions that leave the set."""
    own = counts.filter(F.col("state").isin(*inside))
    out = own.groupBy("state").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("next_state").isin(*inside), 0).otherwise(F.col("n"))).alias("escapes"))
    return out.withColumn("p_escape", ratio(F.col("escapes"), F.col("n")))


# Mechanisms that make an escape from a stuck set likely.
MECHANISMS = ("loop detection", "max retry", "alternative hypothesis generation", "forced state reclassification", "backtracking", "reset context", "ask user", "switch tool", "lower-level diagnostic", "verifier-triggered repair")


def escapes_by_mechanism(traj: DataFrame, inside: Sequence[str], width: int = 10_000) -> DataFrame:
    """(mechanism, used, escapes, p_escape) of each mechanism taken as an action in a state of the set, and of escapes without any ('none').

    An escape, a step from the set out of it, is credited to the last mechanism that the run has taken since it
    entered the set, the escaping step's own included. The last entry and the last mechanism are
    carried from bucket to bucket of width steps, so a long run spreads over its buckets.
    """
    within = lambda c: F.coalesce(F.col(c).isin(*inside), F.lit(False))
    used = within("state") & F.coalesce(F.col("action").isin(*MECHANISMS), F.lit(False))
    rows = traj.select("run_id", "step", F.floor(F.col("step") / width).alias("bucket"), F.when(used, F.col("action")).alias("mechanism"), (within("state") & F.col("has_next") & ~within("next_state")).alias("escapes"), (F.col("has_next") & ~within("state") & within("next_state")).alias("enters"))
    marks = rows.filter("mechanism IS NOT NULL OR escapes OR enters")
    last = {"entered": F.max(F.when(F.col("enters"), F.col("step"))), "taken": F.max(F.when(F.col("mechanism").isNotNull(), F.struct("step", "mechanism")))}
    near, far = Window.partitionBy("run_id", "bucket").orderBy("step").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.groupBy("run_id", "bucket").agg(*[v.alias(c) for c, v in last.items()]).select("run_id", "bucket", *[F.max(c).over(far).alias(f"{c}_before") for c in last])
    met = marks.select("run_id", "bucket", "escapes", *[v.over(near).alias(c) for c, v in last.items()]).filter("escapes").join(before, ["run_id", "bucket"])
    taken, entered = F.coalesce("taken", "taken_before"), F.coalesce("entered", "entered_before", F.lit(-1))
    credit = F.when(taken["step"] > entered, taken["mechanism"])
    told = met.select(F.coalesce(credit, F.lit("none")).alias("mechanism"), F.lit(0).alias("used"), F.lit(1).alias("escape")).union(rows.filter("mechanism IS NOT NULL").select("mechanism", F.lit(1), F.lit(0)))
    out = told.groupBy("mechanism").agg(F.sum("used").alias("used"), F.sum("escape").alias("escapes"))
    return out.withColumn("p_escape", ratio(F.col("escapes"), F.col("used")))


def failure_entry(counts: DataFrame, failures: Sequence[str], k: int) -> DataFrame:
    """The k states outside failures from which a step most often enters them; ties by name."""
    own = counts.filter(~F.col("state").isin(*failures)).groupBy("state").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("next_state").isin(*failures), F.col("n")).otherwise(0)).alias("entries"))
    return own.withColumn("p_fail", ratio(F.col("entries"), F.col("n"))).orderBy(F.desc("p_fail"), "state").limit(k)


# Outcome labels; their order of precedence is ours.
OUTCOMES = ("reached target", "reached false completion", "stuck", "loop", "tool error", "user clarification needed", "context missing", "wrong decomposition", "wrong action")


def outcome_labels(runs: DataFrame) -> DataFrame:
    """runs with outcome: the first label of OUTCOMES whose boolean column (its words joined by _) is true, else 'unfinished'; null flags count as false."""
    flags = [(label, label.replace(" ", "_")) for label in OUTCOMES]
    return runs.withColumn("outcome", F.coalesce(*[F.when(F.col(c), F.lit(label)) for label, c in flags if c in runs.columns], F.lit("unfinished")))


# What is wrong, and the means that mends it.
REMEDIES = (
    ("action too divergent", "tighten the action space"),
    ("state incomplete", "change the mapper or the state schema"),
    ("false completion", "add a verifier"),
    ("stuck", "add an escape transition"),
    ("tool misuse", "change the tool description or the parameter schema"),
    ("weak policy", "change the system prompt, few-shot examples or training data"),
    ("weak long-range planning", "introduce a planner or search"),
)


def remedies(problems: DataFrame) -> DataFrame:
    """problems with remedy, null where the class is unknown. The lookup has one row per class."""
    known = problems.sparkSession.createDataFrame(list(REMEDIES), "problem string, remedy string")
    return problems.join(F.broadcast(known), "problem", "left")


def evaluation(traj: DataFrame, goals: Sequence[str], failures: Sequence[str], tool_error: str, completed: Column, verified: Column, intervened: Column, by: Sequence[str] = ("variant",)) -> DataFrame:
    """One row per variant (or by): runs, mean steps, and the eight measures that two systems are compared by.

    completed: the step claims that the run is done; verified: whether that claim holds (null:
    not looked at); intervened: the step needs the user. A completion is false if any claim
    of the run fails; runs without a claim do not count there. The first intervention's step
    tells how early the user is asked.
    """
    per = traj.groupBy(*by, "run_id").agg(
        F.count("*").alias("n_steps"),
        F.min(F.when(F.col("state").isin(*goals), F.col("step"))).alias("tau_g"),
        F.min(F.when(F.col("state").isin(*failures), F.col("step"))).alias("tau_f"),
        F.count_if(F.col("has_next") & F.col("state").eqNullSafe(F.col("next_state"))).alias("retries"),
        F.count_if(F.col("state") == tool_error).alias("errors"),
        F.max(completed & verified.isNotNull()).alias("claimed"),
        F.max(completed & ~verified).alias("false_claim"),
        F.min(F.when(intervened, F.col("step"))).alias("asked_at"),
        F.sum("cost").alias("cost"),
    )
    share = lambda c: F.round(F.avg(c.cast("double")), PLACES)
    return per.groupBy(*by).agg(
        F.count("*").alias("runs"),
        share(succeeded()).alias("success_rate"),
        ratio(F.count_if("false_claim"), F.count_if("claimed")).alias("false_completion_rate"),
        F.round(F.avg(F.when(succeeded(), F.col("tau_g"))), PLACES).alias("mean_hitting_time"),
        F.round(F.avg("n_steps"), PLACES).alias("mean_steps"),
        F.round(F.avg("retries"), PLACES).alias("mean_retries"),
        share(F.col("retries") >= 3).alias("loop_rate"),
        ratio(F.sum("errors"), F.sum("n_steps")).alias("error_rate"),
        share(F.col("asked_at").isNotNull()).alias("intervention_rate"),
        F.round(F.avg("asked_at"), PLACES).alias("mean_steps_to_question"),
        F.round(F.avg("cost"), 4).alias("mean_cost"),
    )


#: Measures of evaluation() and whether more is better.
DIRECTIONS = {"success_rate": True, "false_completion_rate": False, "mean_hitting_time": False, "mean_steps": False, "mean_retries": False, "loop_rate": False, "error_rate": False, "intervention_rate": False, "mean_steps_to_question": False, "mean_cost": False}


def _compared(table: DataFrame, baseline, variant, by: Sequence[str] = ()) -> DataFrame:
    """(by, measure, baseline, value, delta, better) of a table with one row per variant and by."""
    long = table.select("variant", *by, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(up).alias("up")) for m, up in DIRECTIONS.items()])).alias("x")).select("variant", *by, "x.*")
    pick = lambda v: F.max(F.when(F.col("variant") == F.lit(v), F.col("value")))
    met = long.groupBy(*by, "measure", "up").agg(pick(baseline).alias("baseline"), pick(variant).alias("value"))
    better = F.coalesce(F.when(F.col("up"), F.col("value") > F.col("baseline")).otherwise(F.col("value") < F.col("baseline")), F.lit(False))
    return met.select(*by, "measure", "baseline", "value", F.round(F.col("value") - F.col("baseline"), 4).alias("delta"), better.alias("better"))


def verdict(table: DataFrame, repeats: DataFrame, baseline, variant) -> DataFrame:
    """One row per measure: both values, delta, better; in how many repeats it is better, whether in all of them (stable); and all_stable over every measure.

    table has one row per variant, repeats one per variant and repeat (tasks or reruns).
    """
    often = _compared(repeats, baseline, variant, ("repeat",)).groupBy("measure").agg(F.count_if("better").alias("repeats_better"), F.count("*").alias("repeats"))
    # One row per measure, of which there are a handful.
    met = _compared(table, baseline, variant).join(F.broadcast(often), "measure").withColumn("stable", F.col("better") & (F.col("repeats_better") == F.col("repeats")))
    return met.join(F.broadcast(met.agg(F.min("stable").alias("all_stable"))))


def paired(per_run: DataFrame, task: str, variant: str, value: str, baseline, other) -> DataFrame:
    """(task, baseline, other, delta): each task's mean value under two variants, only tasks that have both."""
    pick = lambda v: F.avg(F.when(F.col(variant) == F.lit(v), F.col(value)))
    met = per_run.groupBy(task).agg(pick(baseline).alias("baseline"), pick(other).alias("other")).dropna(subset=["baseline", "other"])
    return met.select(task, F.round("baseline", 4).alias("baseline"), F.round("other", 4).alias("other"), F.round(F.col("other") - F.col("baseline"), 4).alias("delta"))


def n_step(matrix: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """(state, p) after n moves from start (state, p). States that nothing leaves keep their mass."""
    stay = start.select("state").union(matrix.select(F.col("next_state").alias("state"))).distinct().join(matrix.select("state").distinct(), "state", "left_anti")
    # One row per edge of the vocabulary; the lineage is cut every few moves.
    moves = landed(matrix.select("state", "next_state", F.col("n").cast("double").alias("n")).union(stay.select("state", F.col("state"), F.lit(1.0))), "moves")
    total = Window.partitionBy("state")
    moves = moves.select("state", "next_state", (F.col("n") / F.sum("n").over(total)).alias("q"))
    now = start.select("state", F.col("p").cast("double").alias("p"))
    for i in range(n):
        now = now.join(moves, "state").groupBy(F.col("next_state").alias("state")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        if i % 8 == 7 and i < n - 1:
            now = landed(now, "n-step")
    return now.select("state", F.round("p", PLACES).alias("p"))
