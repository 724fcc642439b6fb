"""Chains, classes, loops, communities, survival, resampling and planning against plain Python and numpy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailnote.operators import chains, classes, planning, ranges, repetition, resampling, survival, trajectory as tr

COUNTS = "state string, next_state string, n long"


def name(i):
    return f"s{i:04d}"


def sparse(rng, n, out=4):
    """Random counted transitions of n states; the last two are goal and failure."""
    rows = Counter()
    for i in range(n - 2):
        for _ in range(out):
            rows[(name(i), name(rng.choice([n - 1, n - 2]) if rng.random() < 0.4 else rng.randrange(n - 2)))] += rng.randrange(1, 5)
    return [(a, b, k) for (a, b), k in rows.items()]


def test_absorption_equals_numpy(spark):
    rng, n = random.Random(3), 150
    rows = sparse(rng, n) + [("lost", "lost", 2), ("out", "lost", 1), (None, "lost", 5), ("lost", None, 5)]
    states = sorted({s for r in rows for s in r[:2] if s})
    at = {s: i for i, s in enumerate(states)}
    p = np.zeros((len(states), len(states)))
    for a, b, k in rows:
        if a and b:
            p[at[a], at[b]] += k
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    goal, failure = at[name(n - 2)], at[name(n - 1)]
    inner = [i for i, s in enumerate(states) if i not in (goal, failure) and s not in ("lost", "out")]
    q, b = p[np.ix_(inner, inner)], p[inner, goal]
    h = np.linalg.solve(np.eye(len(inner)) - q, b)
    m = np.linalg.solve(np.eye(len(inner)) - q, h)
    got = {r.state: r for r in chains.absorption(spark.createDataFrame(rows, COUNTS), [name(n - 2)], [name(n - 1)]).collect()}
    assert set(got) == set(states)
    for i, k in enumerate(inner):
        assert math.isclose(got[states[k]].p_success, h[i], abs_tol=1e-6)
        if h[i] > 1e-6:
            assert math.isclose(got[states[k]].steps, m[i] / h[i], rel_tol=1e-6, abs_tol=1e-5)
    assert (got[name(n - 2)].p_success, got[name(n - 2)].steps) == (1.0, 0.0)
    assert (got[name(n - 1)].p_success, got[name(n - 1)].steps) == (0.0, None)
    assert (got["lost"].p_success, got["lost"].steps, got["out"].p_success) == (0.0, None, 0.0)


def test_chains_of_nothing(spark):
    none = spark.createDataFrame([], COUNTS)
    assert chains.absorption(none, ["g"], ["f"]).count() == 0
    assert classes.recurrent_classes(none).count() == 0
    assert classes.communities(none).count() == 0


def strong(edges, states):
    """Classes by reachability, plainly."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    reach = {}
    for s in states:
        seen, todo = set(), [s]
        while todo:
            for t in after[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        reach[s] = seen
    return {s: min({s} | {t for t in reach[s] if s in reach[t]}) for s in states}, reach


def test_strong_classes_equal_reachability(spark):
    """Sparse, middling and dense graphs side by side, with a ring and a path that one move a round would not get through."""
    rng, edges = random.Random(1), {("z", "z"), ("y", "z")}
    for k, (n, m) in enumerate([(40, 45), (60, 90), (30, 200)]):
        edges |= {(f"{k}{name(rng.randrange(n))}", f"{k}{name(rng.randrange(n))}") for _ in range(m)}
    states = sorted({s for e in edges for s in e})
    want, reach = strong(edges, states)
    size = Counter(want.values())
    closed = {c: all(want[t] == c for s in states if want[s] == c for t in reach[s]) for c in size}
    long = 400
    more = [(f"r{i:05d}", f"r{(i + 1) % long:05d}") for i in range(long)] + [(f"t{i:05d}", f"t{i + 1:05d}") for i in range(long)]
    got = {r.state: (r.class_id, r.class_size, r.closed, r.stuck) for r in classes.recurrent_classes(spark.createDataFrame(sorted(edges) + more, "state string, next_state string"), ["z"]).collect()}
    for s, c in want.items():
        assert got[s] == (c, size[c], closed[c], closed[c] and c != "z")
    assert all(got[a] == ("r00000", long, True, True) for a, _ in more[:long])
    assert all(got[a] == (a, 1, False, False) for a, _ in more[long:]) and got[f"t{long:05d}"] == (f"t{long:05d}", 1, True, True)
    assert len(got) == len(states) + 2 * long + 1


def test_periodic_stretches_equal_brute_force(spark):
    rng = random.Random(8)
    runs = {f"r{k}": "".join(rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randrange(0, 60))) for k in range(12)}
    runs["hot"] = "x" + "abc" * 40 + "ab" + "zz" + "abab" * 9 + "q" * 21 + "abcd" * 2
    rows = [(run, i, s) for run, states in runs.items() for i, s in enumerate(states)]
    traj = spark.createDataFrame(rows, "run_id string, step long, state string").repartition(5)
    longest, want = 5, set()
    for run, s in runs.items():
        for p in range(1, longest + 1):
            t = 0
            while t + p < len(s):
                e = t
                while e + p < len(s) and s[e] == s[e + p]:
                    e += 1
                if e - t >= p and not any(p % d == 0 and all(s[k] == s[k + d] for k in range(t, e + p - d)) for d in range(1, p)):
                    want.add((run, t, p, (e - t + p) // p, e - t + p))
                t = max(e, t) + 1
    for width in (4096, 16):
        got = repetition.periodic_stretches(traj, longest=longest, width=width).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want, width
    assert ("hot", 1, 3, 40, 122) in want


def test_planted_blocks_and_their_bridges(spark):
    rng = random.Random(4)
    rows = Counter()
    for _ in range(3000):
        block = rng.randrange(2)
        rows[(f"{'ab'[block]}{rng.randrange(20)}", f"{'ab'[block]}{rng.randrange(20)}")] += 1
    rows[("a3", "b4")] += 2
    rows[("b9", "a1")] += 1
    n = spark.createDataFrame([(a, b, k) for (a, b), k in rows.items()], COUNTS)
    found = classes.communities(n)
    by = defaultdict(set)
    for r in found.collect():
        by[r.community].add(r.state)
    assert sorted({s[0] for s in v} for v in by.values()) == [{"a"}, {"b"}] and sum(map(len, by.values())) == 40
    assert {(r.state, r.next_state, r.n) for r in classes.bridges(n, found).collect()} == {("a3", "b4", 2), ("b9", "a1", 1)}
    w = sum(k for (a, b), k in rows.items() if a != b)
    for r in classes.community_cuts(n, found).collect():
        inside = sum(2 * k for (a, b), k in rows.items() if a != b and a in by[r.community] and b in by[r.community])
        assert (r.n_states, r.inside, r.cut) == (20, inside, 3)
        assert r.conductance == round(3 / min(inside + 3, 2 * w - inside - 3), 6)
        assert r.modularity == round(inside / (2 * w) - ((inside + 3) / (2 * w)) ** 2, 6)


def test_stationary_equals_numpy_and_periods(spark):
    rng = random.Random(6)
    rows = Counter()
    for i in range(60):
        rows[(name(i), name((i + 1) % 60))] += 1
        for _ in range(3):
            rows[(name(i), name(rng.randrange(60)))] += rng.randrange(1, 9)
    ring = [(f"p{i}", f"p{(i + 1) % 6}", 1) for i in range(6)] + [("p0", "p3", 2), ("in", "p0", 1)]
    single = [("w", "end", 1)]
    n = spark.createDataFrame([(a, b, k) for (a, b), k in rows.items()] + ring + single, COUNTS)
    got = chains.stationary(n, classes.recurrent_classes(n.select("state", "next_state"))).collect()
    p = np.zeros((60, 60))
    for (a, b), k in rows.items():
        p[int(a[1:]), int(b[1:])] = k
    p /= p.sum(1, keepdims=True)
    values, vectors = np.linalg.eig(p.T)
    pi = np.real(vectors[:, np.argmin(abs(values - 1))])
    pi /= pi.sum()
    found = {r.state: r for r in got}
    assert all(math.isclose(found[name(i)].p, pi[i], abs_tol=2e-6) and found[name(i)].period == 1 for i in range(60))
    # Cycles of 6 and, by the short cut from p0 to p3, of 4: period 2.
    assert {found[f"p{i}"].period for i in range(6)} == {2}
    assert found["p0"].p == pytest.approx(3 / 14, abs=1e-6) and found["p1"].p == pytest.approx(1 / 14, abs=1e-6)
    assert (found["end"].p, found["end"].period) == (1.0, None) and "in" not in found and "w" not in found


@pytest.mark.parametrize("period", [2, 3])
def test_stationary_of_a_cycle_with_parts_of_unlike_size(spark, period):
    """The first part has five states and the others one: each part still gets the same share."""
    moves = [(f"a{i}", "p1", i + 1) for i in range(5)] + [(f"p{k}", f"p{k + 1}", 1) for k in range(1, period - 1)] + [(f"p{period - 1}", f"a{i}", i + 1) for i in range(5)]
    n = spark.createDataFrame(moves, "state string, next_state string, n long")
    got = {r.state: (r.p, r.period) for r in chains.stationary(n, classes.recurrent_classes(n.select("state", "next_state"))).collect()}
    assert got == {f"a{i}": (round((i + 1) / 15 / period, 6), period) for i in range(5)} | {f"p{k}": (round(1 / period, 6), period) for k in range(1, period)}


def test_mixing_steps(spark):
    two = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "a", 1), ("b", "b", 3)], COUNTS)
    goal = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "state string, p double")
    start = spark.createDataFrame([("a", 1.0)], "state string, p double")
    # The distance halves with each move, from 1/2.
    assert chains.mixing_steps(two, goal, start, 0.13) == 2
    swing = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], COUNTS)
    assert chains.mixing_steps(swing, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "state string, p double"), start, most=3) is None


def test_risks_equal_plain_sums(spark):
    rng = random.Random(7)
    rows = [(rng.choice("uv"), rng.randrange(12), rng.choice(["goal", "goal", "failure", "censored"])) for _ in range(400)]
    got = {(r.v, r.time): r for r in survival.risks(spark.createDataFrame(rows, "v string, time long, kind string").repartition(7), ["v"]).collect()}
    for v in "uv":
        own = [r for r in rows if r[0] == v]
        alive, g, f = 1.0, 0.0, 0.0
        for t in sorted({r[1] for r in own}):
            risk = sum(r[1] >= t for r in own)
            d = Counter(r[2] for r in own if r[1] == t)
            g, f = g + alive * d["goal"] / risk, f + alive * d["failure"] / risk
            alive *= 1 - (d["goal"] + d["failure"]) / risk
            r = got.pop((v, t))
            assert (r.at_risk, r.goals, r.failures, r.censored) == (risk, d["goal"], d["failure"], d["censored"])
            assert (r.survival, r.p_goal, r.p_failure) == pytest.approx((alive, g, f), abs=2e-6)
            assert r.survival + r.p_goal + r.p_failure == pytest.approx(1, abs=3e-6)
    assert not got
    end = survival.risks(spark.createDataFrame([(1, "goal"), (1, "goal")], "time long, kind string")).first()
    assert (end.at_risk, end.survival, end.p_goal) == (2, 0.0, 1.0)


def test_running_sums_over_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "x", None]), i, rng.randrange(9)) for i in range(500)]
    parts = ranges.ranged(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"])
    got = {(r.k, r.i): r.s for r in ranges.running(parts, ["k"], ["i"], {"s": F.col("v")}).collect()}
    sums = Counter()
    for k, i, v in rows:
        assert got[(k, i)] == sums[k]
        sums[k] += v


def test_resampling(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, float(rng.random() < (0.8 if i % 2 else 0.4)), rng.gauss(5, 1)) for i in range(400)]
    units = spark.createDataFrame(rows, "unit long, variant long, ok double, x double")
    measures = {"ok": (F.col("ok"), F.lit(1)), "x": (F.col("x"), F.lit(1)), "none": (F.lit(None), F.lit(None))}
    got = {r.measure: r for r in resampling.bootstrap(units, "unit", measures, 0, 1).collect()}
    again = {r.measure: r for r in resampling.bootstrap(units.repartition(7), "unit", measures, 0, 1).collect()}
    assert got == again
    assert got["ok"].low > 0.25 and got["ok"].high < 0.55 and got["ok"].chance == 0.0
    assert got["ok"].low < got["ok"].delta < got["ok"].high
    assert got["x"].low < 0 < got["x"].high and got["x"].chance > 0.05
    assert got["none"].delta is None
    # The draws are Poisson: as many units a replicate as there are, and a third of them not at all.
    draws = spark.range(20_000).select(resampling.drawn("s", F.col("id"), F.lit(1)).alias("u")).agg(F.avg("u"), F.count_if(F.col("u") < resampling.POISSON[0]) / 20_000).first()
    assert draws[0] == pytest.approx(0.5, abs=0.01) and draws[1] == pytest.approx(math.exp(-1), abs=0.01)
    flips = lambda shift: resampling.sign_flips(spark.createDataFrame([(i, rng.gauss(shift, 1)) for i in range(60)] + [(99, None)], "t long, d double"), "t", "d").first()
    clear, none = flips(1.0), flips(0.0)
    assert clear.tasks == 60 and clear.chance == 0.001 and none.chance > 0.02


def test_best_policy_equals_plain_induction(spark):
    rng = random.Random(5)
    moves = Counter()
    for s in range(12):
        for a in "xyz":
            for _ in range(4):
                moves[(f"s{s}", a, rng.choice([f"s{rng.randrange(12)}", "goal", "fail"]))] += rng.randrange(1, 6)
    rows = [(s, a, t, n) for (s, a, t), n in moves.items()]
    allowed = [(f"s{s}", a) for s in range(11) for a in "xyz" if rng.random() < 0.6]
    total = Counter()
    for s, a, t, n in rows:
        total[(s, a)] += n
    df = spark.createDataFrame(rows, "state string, action string, next_state string, n long")
    for which in (None, allowed):
        got = {(r.steps_left, r.state): r for r in planning.best_policy(df, ["goal"], ["fail"], 6, which and spark.createDataFrame(which, "state string, action string")).collect()}
        value = {}
        for k in range(1, 7):
            now = defaultdict(float)
            for s, a, t, n in rows:
                if which is None or (s, a) in which:
                    now[(s, a)] += n / total[(s, a)] * (1 if t == "goal" else 0 if t == "fail" else value.get(t, 0))
            value = {s: max(v for (x, _), v in now.items() if x == s) for s, _ in now}
            for s, v in value.items():
                r = got.pop((k, s))
                assert r.value == pytest.approx(v, abs=1e-6) and now[(s, r.action)] == pytest.approx(v, abs=1e-9)
        assert not got
    uniform = spark.createDataFrame([(f"s{s}", a, 1 / 3) for s in range(12) for a in "xyz"], "state string, action string, p double")
    worth = {}
    for _ in range(5):
        worth = {s: sum(n / total[(x, a)] / 3 * (1 if t == "goal" else 0 if t == "fail" else worth.get(t, 0)) for x, a, t, n in rows if x == s) for s in {r[0] for r in rows}}
    assert {r.state: r.value for r in planning.policy_value(df, uniform, ["goal"], ["fail"], 5).collect()} == pytest.approx(worth, abs=1e-6)


def test_outcomes_of_runs(spark):
    taus = spark.createDataFrame([(1, 5, 2, None), (2, 5, 2, 2), (3, 5, None, None), (4, 5, 3, 1)], "run_id long, n_steps long, tau_g long, tau_f long")
    assert {r.run_id: (r.kind, r.time) for r in survival.outcomes(taus).collect()} == {1: ("goal", 2), 2: ("failure", 2), 3: ("censored", 4), 4: ("failure", 1)}
    assert tr.success_before_failure(taus).first().successes == 1
