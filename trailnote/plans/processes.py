"""Queries over trajectories as processes: absorption, classes, loops, communities, survival, resampling, planning."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.operators import chains, classes, planning, repetition, resampling, survival, trajectory as tr
from trailnote.plans.bindings import FAILURES, GOALS, TAUS, TRAJECTORY, trajectory
from trailnote.plans.pack import Pack
from trailnote.sources.tables import table

pack = Pack()
_N = TRAJECTORY + ", n AS (SELECT state, next_state, count(*) AS n FROM e WHERE has_next GROUP BY ALL)"
#: The same with one state for each user and event type.
_USER_N = TRAJECTORY + ", n AS (SELECT run_id || ':' || state AS state, run_id || ':' || next_state AS next_state, count(*) AS n FROM e WHERE has_next GROUP BY ALL)"
_ENDS = "split_part({0}, ':', -1)"


def _user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of each user as a chain of its own, all in one graph; a state is (user, kind)."""
    of = lambda c: F.struct(F.col("run_id").alias("user"), F.col(c).alias("kind"))
    steps = trajectory(spark, sf_dir).filter("has_next AND next_state IS NOT NULL")
    return steps.groupBy(of("state").alias("state"), of("next_state").alias("next_state")).agg(F.count("*").alias("n"))


def _named(c: str = "state"):
    return F.concat(F.col(f"{c}.user").cast("string"), F.lit(":"), F.col(f"{c}.kind"))


def _absorption(rounds: int) -> str:
    goal, fail = (_ENDS.format("q.next_state") + f" = '{x}'" for x in ("purchase", "error"))
    return f"""q AS MATERIALIZED (SELECT state, next_state, n::DOUBLE / sum(n) OVER (PARTITION BY state) AS q FROM n), a AS (SELECT state FROM n UNION SELECT next_state FROM n),
i AS MATERIALIZED (SELECT q.*, {goal} AS goal, {fail} AS fail FROM q WHERE {_ENDS.format('state')} NOT IN ('purchase', 'error')),
d(k, state, h, m) AS (SELECT 0, state, 0::DOUBLE, 0::DOUBLE FROM i GROUP BY state UNION ALL
  SELECT max(coalesce(d.k, 0)) OVER () + 1, i.state, i.h, i.m FROM (SELECT max(d.k) AS k, i.state, sum(i.q * CASE WHEN goal THEN 1 WHEN fail THEN 0 ELSE coalesce(d.h, 0) END) AS h, sum(i.q * CASE WHEN goal THEN 1 WHEN fail THEN 0 ELSE coalesce(d.m + d.h, 0) END) AS m FROM i LEFT JOIN d ON d.state = i.next_state GROUP BY i.state) i, (SELECT max(k) AS k FROM d) d WHERE d.k < {rounds}),
s AS (SELECT a.state, CASE WHEN {_ENDS.format('a.state')} = 'purchase' THEN 1 ELSE coalesce(d.h, 0) END AS h, coalesce(d.m, 0) AS m FROM a LEFT JOIN d ON d.state = a.state AND d.k = {rounds})
SELECT state, round(h, 6) AS p_success, round(CASE WHEN h > 1e-9 THEN m / h END, 6) AS steps FROM s"""


@pack.add(f"WITH RECURSIVE {_N}, {_absorption(200)}")
def tr8_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.absorption(tr.transition_counts(trajectory(spark, sf_dir)), GOALS, FAILURES)


@pack.add(f"WITH RECURSIVE {_USER_N}, {_absorption(1500)}")
def tr9_absorption_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chains.absorption(_user_counts(spark, sf_dir), GOALS, FAILURES, "state.kind")
    return found.select(_named().alias("state"), "p_success", "steps")


@pack.add(f"""WITH RECURSIVE {_USER_N}, reach(state, other) AS (SELECT state, next_state FROM n UNION SELECT r.state, n.next_state FROM reach r JOIN n ON r.other = n.state),
a AS (SELECT state FROM n UNION SELECT next_state FROM n), m AS (SELECT x.state, x.other FROM reach x JOIN reach y ON x.state = y.other AND x.other = y.state UNION SELECT state, state FROM a),
k AS (SELECT state, min(other) AS class_id, count(DISTINCT other) AS class_size FROM m GROUP BY state),
o AS (SELECT k.class_id, bool_or(k.class_id <> j.class_id) AS leaves FROM reach r JOIN k USING (state) JOIN k j ON j.state = r.other GROUP BY 1)
SELECT state, class_id, class_size, NOT coalesce(leaves, false) AS closed FROM k LEFT JOIN o USING (class_id)""")
def tr13_user_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of each user's chain; states are named as text, so the smallest name is the same in SQL."""
    n = _user_counts(spark, sf_dir).select(_named().alias("state"), _named("next_state").alias("next_state"), "n")
    return classes.recurrent_classes(n).drop("stuck")


@pack.add(f"""WITH {TRAJECTORY}, k(p) AS (SELECT unnest(range(1, 9))), m AS (SELECT a.run_id, p, a.step FROM e a, k, e b WHERE b.run_id = a.run_id AND b.step = a.step + p AND b.state = a.state AND b.action = a.action),
i AS (SELECT run_id, p, step, step - row_number() OVER (PARTITION BY run_id, p ORDER BY step) AS island FROM m),
s AS (SELECT run_id, min(step) AS start, max(step) + p AS last, p FROM i GROUP BY run_id, p, island HAVING count(*) >= p)
SELECT run_id, start::BIGINT AS start, min(p) AS period, ((last - start + 1) // min(p))::BIGINT AS repeats, (last - start + 1)::BIGINT AS length FROM s GROUP BY run_id, start, last""")
def tr12_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops over state and action, of one to eight steps."""
    return repetition.periodic_stretches(trajectory(spark, sf_dir), ("state", "action"))


def _communities(rounds: int) -> str:
    steps = []
    for r in range(rounds):
        half = f"(md5(x.state || ':{r // 2}')[1] < '8') = {str(r % 2 == 0).lower()}"
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.state, coalesce(b.community, c.community) AS community FROM c{r} c LEFT JOIN (
  SELECT x.state, c.community, row_number() OVER (PARTITION BY x.state ORDER BY sum(w) DESC, c.community <> o.community, c.community) AS place FROM u x JOIN c{r} c ON c.state = x.other JOIN c{r} o ON o.state = x.state WHERE {half} GROUP BY x.state, c.community, o.community) b ON b.state = c.state AND b.place = 1)""")
    return f"""u AS MATERIALIZED (SELECT state, other, sum(n)::BIGINT AS w FROM (SELECT state, next_state AS other, n FROM n WHERE state <> next_state UNION ALL SELECT next_state, state, n FROM n WHERE state <> next_state) GROUP BY ALL),
c0 AS (SELECT state, state AS community FROM (SELECT state FROM n UNION SELECT next_state FROM n)), {', '.join(steps)}, f AS MATERIALIZED (SELECT * FROM c{rounds})"""


@pack.add(f"WITH {_USER_N}, {_communities(8)} SELECT state, community FROM f")
def tr15_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _user_counts(spark, sf_dir).select(_named().alias("state"), _named("next_state").alias("next_state"), "n")
    return classes.communities(n, 8)


def _region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer's nation to the nation of the supplier of its line, for lines that stay in a region or leave it rarely."""
    nation = table(spark, sf_dir, "nation")
    here, there = (nation.select(F.col("n_nationkey").alias(f"{c}_key"), F.col("n_name").alias(c), F.col("n_regionkey").alias(f"{c}_region")) for c in ("state", "next_state"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    buyers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("state_key")), "o_custkey")
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("next_state_key"))
    met = lines.join(buyers, "l_orderkey").join(sellers, "l_suppkey").join(F.broadcast(here), "state_key").join(F.broadcast(there), "next_state_key")
    return met.filter("state_region = next_state_region OR l_quantity > 48").groupBy("state", "next_state").agg(F.count("*").alias("n"))


_REGION_N = """n AS (SELECT a.n_name AS state, b.n_name AS next_state, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_regionkey = b.n_regionkey OR l_quantity > 48 GROUP BY ALL)"""


@pack.add(f"""WITH {_REGION_N}, {_communities(8)}, t AS (SELECT sum(w) AS total FROM u),
s AS (SELECT a.community, sum(w) AS volume, coalesce(sum(w) FILTER (a.community = b.community), 0) AS inside FROM u JOIN f a ON a.state = u.state JOIN f b ON b.state = u.other GROUP BY a.community),
z AS (SELECT community, count(*) AS n_states FROM f GROUP BY community)
SELECT community, n_states, coalesce(volume, 0)::BIGINT AS volume, coalesce(inside, 0)::BIGINT AS inside, coalesce(volume - inside, 0)::BIGINT AS cut, round((volume - inside) / nullif(least(volume, total - volume), 0), 6) AS conductance, round(coalesce(inside, 0) / total - pow(coalesce(volume, 0) / total, 2), 6) AS modularity FROM z LEFT JOIN s USING (community), t""")
def tr15_community_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _region_counts(spark, sf_dir)
    return classes.community_cuts(n, classes.communities(n, 8))


@pack.add(f"""WITH {_REGION_N}, {_communities(8)}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY state) AS p FROM n)
SELECT p.state, p.next_state, a.community, b.community AS to_community, n, round(p, 6) AS p FROM p JOIN f a ON a.state = p.state JOIN f b ON b.state = p.next_state WHERE a.community <> b.community""")
def tr15_community_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _region_counts(spark, sf_dir)
    return classes.bridges(n, classes.communities(n, 8))


@pack.add(f"""WITH {TAUS}, o AS (SELECT variant, CASE WHEN ok THEN tau_g ELSE coalesce(tau_f, n_steps - 1) END AS time, CASE WHEN ok THEN 'g' WHEN tau_f IS NOT NULL THEN 'f' ELSE 'c' END AS kind FROM h),
c AS (SELECT variant, time, count(*) FILTER (kind = 'g') AS goals, count(*) FILTER (kind = 'f') AS failures, count(*) FILTER (kind = 'c') AS censored FROM o GROUP BY ALL),
risk AS (SELECT *, (sum(goals + failures + censored) OVER (PARTITION BY variant ORDER BY time DESC))::BIGINT AS at_risk FROM c),
s AS (SELECT *, product(1 - (goals + failures) / at_risk) OVER (PARTITION BY variant ORDER BY time) AS s FROM risk),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY variant ORDER BY time), 1) AS before FROM s)
SELECT variant, time::BIGINT AS time, at_risk, goals, failures, censored, round(s, 6) AS survival, round(sum(before * goals / at_risk) OVER (PARTITION BY variant ORDER BY time), 6) AS p_goal, round(sum(before * failures / at_risk) OVER (PARTITION BY variant ORDER BY time), 6) AS p_failure FROM b""")
def tr9_censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long runs last until a purchase or an error, by variant; runs that see neither are cut off at their end."""
    taus = tr.hitting_times(trajectory(spark, sf_dir), GOALS, FAILURES)
    return survival.risks(survival.outcomes(taus), ["variant"])


_FLOW = "q AS MATERIALIZED (SELECT state, next_state, n::DOUBLE / sum(n) OVER (PARTITION BY state) AS q FROM n)"


def _flow(start: str, rounds: int) -> str:
    return f"""d(k, state, p) AS ({start} UNION ALL SELECT x.k + 1, x.state, x.p FROM (SELECT max(d.k) AS k, q.next_state AS state, sum(d.p * q.q) AS p FROM d JOIN q ON q.state = d.state GROUP BY q.next_state) x WHERE x.k < {rounds})"""


@pack.add(f"WITH RECURSIVE {_N}, {_FLOW}, {_flow('''SELECT 0, state, 1 / count(*) OVER () FROM (SELECT DISTINCT state FROM n)''', 200)} SELECT min(state) OVER () AS class_id, state, round(p, 6) AS p, 1::BIGINT AS period FROM d WHERE k = 200")
def tr22_stationary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tr.transition_counts(trajectory(spark, sf_dir))
    return chains.stationary(n, classes.recurrent_classes(n.select("state", "next_state")))


@pack.add("""WITH o AS (SELECT 'p' || o_orderpriority AS a, 's' || o_orderstatus AS b FROM orders), s AS (SELECT a AS state FROM o UNION ALL SELECT b FROM o)
SELECT (SELECT min(state) FROM s) AS class_id, state, round(count(*) / (2 * (SELECT count(*) FROM o)), 6) AS p, 2::BIGINT AS period FROM s GROUP BY state""")
def tr22_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk between priorities and states of orders, there and back: of period two, so that moving alone would never settle."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), "o_orderpriority").alias("state"), F.concat(F.lit("s"), "o_orderstatus").alias("next_state"))
    n = orders.union(orders.select("next_state", "state")).groupBy("state", "next_state").agg(F.count("*").alias("n"))
    return chains.stationary(n, classes.recurrent_classes(n.select("state", "next_state")))


@pack.add(f"""WITH RECURSIVE {_N}, {_FLOW}, {_flow("SELECT 0, 'signup', 1::DOUBLE", 100)}, z AS (SELECT state, p FROM d WHERE k = 100), t AS (SELECT k, sum(abs(coalesce(d.p, 0) - z.p)) / 2 AS far FROM (SELECT DISTINCT k FROM d) x CROSS JOIN z LEFT JOIN d USING (k, state) GROUP BY k)
SELECT 'signup' AS start, min(k)::BIGINT AS steps FROM t WHERE far <= 0.01""")
def tr22_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tr.transition_counts(trajectory(spark, sf_dir))
    goal = chains.stationary(n, classes.recurrent_classes(n.select("state", "next_state")))
    start = spark.createDataFrame([("signup", 1.0)], "state string, p double")
    return spark.createDataFrame([("signup", chains.mixing_steps(n, goal, start, 0.01))], "start string, steps long")


_POISSON = [sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(12)]
_MEASURES = {"success_rate": ("ok::INT", "1"), "mean_steps": ("n_steps", "1"), "mean_hitting_time": ("CASE WHEN ok THEN tau_g END", "CASE WHEN ok THEN 1 END"), "error_rate": ("errors", "n_steps"), "mean_cost": ("cost", "1")}
_DRAW = "('0x' || md5('{seed}:' || {unit} || ':' || r)[1:8])::BIGINT / 4294967296.0"


@pack.add(f"""WITH {TAUS}, i AS (SELECT unnest(range(0, 201)) AS r), u AS (SELECT h.*, i.r, {_DRAW.format(seed='bootstrap', unit='run_id')} AS u FROM h, i),
w AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {' + '.join(f'(u >= {c!r})::INT' for c in _POISSON)} END AS times FROM u),
s AS (SELECT r, variant, {', '.join(f'sum(times * ({a})) AS {m}_n, sum(times * ({b})) AS {m}_d' for m, (a, b) in _MEASURES.items())} FROM w GROUP BY r, variant),
v AS ({' UNION ALL '.join(f"SELECT '{m}' AS measure, r, max({m}_n / nullif({m}_d, 0)) FILTER (variant = 0) AS a, max({m}_n / nullif({m}_d, 0)) FILTER (variant = 1) AS b FROM s GROUP BY r" for m in _MEASURES)}),
d AS (SELECT *, b - a AS delta FROM v)
SELECT measure, round(max(a) FILTER (r = 0), 6) AS baseline, round(max(b) FILTER (r = 0), 6) AS value, round(max(delta) FILTER (r = 0), 6) AS delta, round(quantile_cont(delta, 0.025) FILTER (r > 0), 6) AS low, round(quantile_cont(delta, 0.975) FILTER (r > 0), 6) AS high,
  round(least(1, 2 * least(count(*) FILTER (r > 0 AND delta <= 1e-12), count(*) FILTER (r > 0 AND delta >= -1e-12)) / count(delta) FILTER (r > 0)), 6) AS chance FROM d GROUP BY measure""")
def tr21_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs drawn anew 200 times: where each measure's difference between the variants lies."""
    traj = trajectory(spark, sf_dir)
    more = traj.groupBy("run_id").agg(F.count_if(F.col("state") == "error").alias("errors"), F.sum("cost").alias("cost"))
    runs = tr.hitting_times(traj, GOALS, FAILURES).join(more, "run_id").withColumn("ok", tr.succeeded())
    one, won = F.lit(1), F.when(F.col("ok"), 1)
    measures = {"success_rate": (F.col("ok").cast("int"), one), "mean_steps": (F.col("n_steps"), one), "mean_hitting_time": (F.when(F.col("ok"), F.col("tau_g")), won), "error_rate": (F.col("errors"), F.col("n_steps")), "mean_cost": (F.col("cost"), one)}
    return resampling.bootstrap(runs, "run_id", measures, 0, 1)


@pack.add(f"""WITH {TAUS}, k AS (SELECT (run_id - variant) // 2 AS task, avg(cost) FILTER (variant = 1) - avg(cost) FILTER (variant = 0) AS d FROM h GROUP BY 1), i AS (SELECT unnest(range(0, 1000)) AS r),
s AS (SELECT r, count(*) AS tasks, sum(CASE WHEN r = 0 OR {_DRAW.format(seed='signs', unit='task::BIGINT')} < 0.5 THEN d ELSE -d END) AS s FROM k, i WHERE d IS NOT NULL GROUP BY r), o AS (SELECT s AS own, tasks FROM s WHERE r = 0)
SELECT tasks, round(own / tasks, 6) AS mean_delta, round((1 + count(*) FILTER (abs(s.s) >= abs(own) - 1e-9)) / (1 + count(*)), 6) AS chance FROM o JOIN (SELECT s FROM s WHERE r > 0) s ON true GROUP BY own, tasks""")
def tr21_sign_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in pairs, one of each variant: is the difference in cost within a pair more than signs at random give?"""
    traj = trajectory(spark, sf_dir).groupBy("run_id", "variant").agg(F.sum("cost").alias("cost"))
    pick = lambda v: F.avg(F.when(F.col("variant") == v, F.col("cost")))
    pairs = traj.groupBy(F.floor(F.col("run_id") / 2).cast("long").alias("task")).agg((pick(1) - pick(0)).alias("delta"))
    return resampling.sign_flips(pairs, "task", "delta")


_BUDGET = 6


def _best(name: str, allowed: str) -> str:
    steps = []
    for k in range(1, _BUDGET + 1):
        value = "0" if k == 1 else "coalesce(v.worth, 0)"
        source = "o" if k == 1 else f"o LEFT JOIN {name}{k - 1} v ON v.state = o.next_state"
        steps.append(f"{name}{k} AS MATERIALIZED (SELECT state, action, got AS worth FROM (SELECT o.state, o.action, sum(q * CASE o.next_state WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 ELSE {value} END) AS got FROM {source} WHERE o.state NOT IN ('purchase', 'error') AND {allowed} GROUP BY o.state, o.action) QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(got, 12) DESC, action) = 1)")
    return ", ".join(steps) + f", {name} AS (" + " UNION ALL ".join(f"SELECT {k} AS steps_left, state, action, worth AS value FROM {name}{k}" for k in range(1, _BUDGET + 1)) + ")"


_MOVES = TRAJECTORY + ", m AS (SELECT state, action, next_state, count(*) AS n FROM e WHERE has_next GROUP BY ALL), o AS MATERIALIZED (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY state, action) AS q FROM m)"
_MASK = "NOT (o.state = 'view' AND o.action = 'high')"


@pack.add(f"""WITH {_MOVES}, {_best('b', 'true')}, {_best('k', _MASK)}
SELECT steps_left, state, b.action, round(b.value, 6) AS value, k.action AS masked_action, round(k.value, 6) AS masked_value FROM b LEFT JOIN k USING (steps_left, state)""")
def tr6_best_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which action gives the best chance of a purchase before an error within one to six steps, and what forbidding one action costs."""
    moves = tr.action_transitions(trajectory(spark, sf_dir))
    allowed = moves.filter("NOT (state = 'view' AND action = 'high')")
    free = planning.best_policy(moves, GOALS, FAILURES, _BUDGET)
    masked = planning.best_policy(moves, GOALS, FAILURES, _BUDGET, allowed).withColumnsRenamed({"action": "masked_action", "value": "masked_value"})
    return free.join(masked, ["steps_left", "state"], "left")


def _worth(name: str, policy: str) -> str:
    steps = []
    for k in range(1, _BUDGET + 1):
        value = "0" if k == 1 else "coalesce(v.value, 0)"
        source = "o" if k == 1 else f"o LEFT JOIN {name}{k - 1} v ON v.state = o.next_state"
        steps.append(f"{name}{k} AS MATERIALIZED (SELECT o.state, sum(y.p * q * CASE o.next_state WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 ELSE {value} END) AS value FROM {source} JOIN {policy} y ON y.state = o.state AND y.action = o.action WHERE o.state NOT IN ('purchase', 'error') AND y.p > 0 GROUP BY o.state)")
    return ", ".join(steps)


@pack.add(f"""WITH {_MOVES}, c AS (SELECT state, action, sum(n) AS n, sum(n) FILTER (NOT (state = 'view' AND action = 'high')) AS k FROM m GROUP BY ALL),
y AS (SELECT state, action, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM c), z AS (SELECT state, action, round(coalesce(k, 0) / nullif(sum(k) OVER (PARTITION BY state), 0), 6) AS p FROM c), {_worth('v', 'y')}, {_worth('w', 'z')}
SELECT state, round(v.value, 4) AS value, round(w.value, 4) AS masked_value FROM v{_BUDGET} v LEFT JOIN w{_BUDGET} w USING (state)""")
def tr6_policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the observed policy is worth within six steps, and what it is with one action masked."""
    traj = trajectory(spark, sf_dir)
    moves, pi = tr.action_transitions(traj), tr.policy(traj)
    masked = tr.masked_policy(pi, pi.filter("NOT (state = 'view' AND action = 'high')")).select("state", "action", F.col("p_masked").alias("p"))
    free = planning.policy_value(moves, pi, GOALS, FAILURES, _BUDGET)
    other = planning.policy_value(moves, masked, GOALS, FAILURES, _BUDGET).withColumnRenamed("value", "masked_value")
    return free.join(other, "state", "left").select("state", F.round("value", 4).alias("value"), F.round("masked_value", 4).alias("masked_value"))
