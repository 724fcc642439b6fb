"""The trajectory calculus on small trajectories with known answers, and properties on the test tables."""

import pytest
from pyspark.sql import functions as F

from trailnote.operators import classes, trajectory as tr
from trailnote.plans.bindings import trajectory

RUNS = {"r1": "abg", "r2": "afg", "r3": "abab", "r4": "g", "r5": "af"}


@pytest.fixture(scope="module")
def traj(spark):
    rows = [(run, i, s, float(i)) for run, states in RUNS.items() for i, s in enumerate(states)]
    steps = spark.createDataFrame(rows, "run string, at long, s string, cost double").repartition(4)
    return tr.indexed(steps, "run", ["at"], "s", F.floor(F.col("at") / 2), keep=("cost",))


def test_buckets_do_not_show(traj):
    got = {}
    for r in sorted(traj.collect(), key=lambda r: (r.run_id, r.step)):
        got.setdefault(r.run_id, []).append((r.step, r.state, r.next_state, r.has_next))
    for run, states in RUNS.items():
        assert got[run] == [(i, s, states[i + 1] if i + 1 < len(states) else None, i + 1 < len(states)) for i, s in enumerate(states)]


def test_known_counts_and_probabilities(traj):
    rows = {(r.state, r.next_state): (r.n, r.p) for r in tr.transition_matrix(traj).collect()}
    assert rows == {("a", "b"): (3, 0.6), ("a", "f"): (2, 0.4), ("b", "g"): (1, 0.5), ("b", "a"): (1, 0.5), ("f", "g"): (1, 1.0)}


def test_known_hitting_times(traj):
    taus = tr.hitting_times(traj, ["g"], ["f"])
    assert {r.run_id: (r.tau_g, r.tau_f) for r in taus.collect()} == {"r1": (2, None), "r2": (2, 1), "r3": (None, None), "r4": (0, None), "r5": (None, 1)}
    one = tr.success_before_failure(taus).first()
    assert (one.runs, one.successes, one.failures, one.censored, one.p_success) == (5, 2, 2, 1, 0.4)
    mean = tr.expected_hitting_time(taus).first()
    assert (mean.mean_given_success, mean.never_hit) == (1.0, 2)


def test_absorbing_and_classes(spark, traj):
    assert [r.state for r in tr.absorbing(traj).filter("absorbing").collect()] == ["g"]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")], "state string, next_state string")
    got = {r.state: (r.class_id, r.class_size, r.closed, r.stuck) for r in classes.recurrent_classes(edges, ["e"]).collect()}
    assert got == {"a": ("a", 2, False, False), "b": ("a", 2, False, False), "c": ("c", 2, True, True), "d": ("c", 2, True, True), "e": ("e", 1, True, False)}


def test_streaks_across_buckets(spark):
    rows = [("r", i, s) for i, s in enumerate("aabbbbbca")] + [("q", 0, "z")]
    steps = tr.indexed(spark.createDataFrame(rows, "run string, at long, s string"), "run", ["at"], "s", F.floor(F.col("at") / 3))
    assert {r.run_id: (r.streak, r.state) for r in tr.longest_streaks(steps, width=4).collect()} == {"r": (5, "b"), "q": (1, "z")}


def test_null_states_and_empty_tables(spark):
    schema = "run string, at long, s string"
    steps = tr.indexed(spark.createDataFrame([("r", 0, None), ("r", 1, None), ("r", 2, "g")], schema), "run", ["at"], "s", F.lit(0))
    assert {(r.state, r.next_state): r.n for r in tr.transition_counts(steps).collect()} == {(None, None): 1, (None, "g"): 1}
    assert tr.hitting_times(steps, ["g"], ["f"]).first().tau_g == 2
    none = tr.indexed(spark.createDataFrame([], schema), "run", ["at"], "s", F.lit(0))
    assert tr.transition_matrix(none).count() == 0 and tr.longest_streaks(none).count() == 0
    assert tr.success_before_failure(tr.hitting_times(none, ["g"], ["f"])).first().p_success is None


def test_properties_on_events(spark, data):
    traj = trajectory(spark, data)
    sums = tr.transition_matrix(traj).groupBy("state").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-5 for r in sums)
    induced = {(r.state, r.next_state): r.p for r in tr.induced_chain(tr.policy(traj), tr.action_transitions(traj)).collect()}
    for r in tr.transition_matrix(traj).collect():
        assert abs(induced[r.state, r.next_state] - r.p) < 1e-3
    start = spark.createDataFrame([("signup", 1.0)], "state string, p double")
    assert abs(sum(r.p for r in tr.n_step(tr.transition_matrix(traj), start, 5).collect()) - 1) < 1e-5
