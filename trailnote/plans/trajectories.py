"""Queries over trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailnote.operators import classes, ranking, trajectory as tr
from trailnote.plans.bindings import FAILURES, GOALS, TAUS, TRAJECTORY, trajectory
from trailnote.plans.pack import Pack
from trailnote.sources.tables import table

pack = Pack()
_N = TRAJECTORY + ", n AS (SELECT state, next_state, count(*) AS n FROM e WHERE has_next GROUP BY ALL)"
_P = _N + ", p AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 6) AS p FROM n)"


@pack.add(f"WITH {TRAJECTORY} SELECT run_id, step::BIGINT AS step, state FROM e")
def win1_step_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory(spark, sf_dir).select("run_id", "step", "state")


@pack.add(f"WITH {TRAJECTORY} SELECT run_id, step::BIGINT AS step, state, coalesce(next_state, '-') AS next_state FROM e")
def win2_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory(spark, sf_dir).select("run_id", "step", "state", F.coalesce("next_state", F.lit("-")).alias("next_state"))


@pack.add(f"WITH {_N} SELECT state, next_state, n FROM n")
def tr1_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transition_counts(trajectory(spark, sf_dir))


@pack.add(f"WITH {_P} SELECT state, next_state, n, p FROM p")
def tr2_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transition_matrix(trajectory(spark, sf_dir))


@pack.add("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_state FROM conversations),
n AS (SELECT role AS state, next_state, count(*) AS n FROM t WHERE next_state IS NOT NULL GROUP BY ALL)
SELECT state, next_state, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 6) AS p FROM n""")
def tr2_role_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = tr.indexed(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", F.floor(F.col("turn") / 64))
    return tr.transition_matrix(talk)


@pack.add(f"WITH {TRAJECTORY}, n AS (SELECT state, action, count(*) AS n FROM e WHERE has_next GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 6) AS p FROM n")
def tr3_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.policy(trajectory(spark, sf_dir))


@pack.add(f"WITH {TRAJECTORY}, n AS (SELECT state, action, next_state, count(*) AS n FROM e WHERE has_next GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY state, action), 6) AS p FROM n")
def tr4_action_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.action_transitions(trajectory(spark, sf_dir))


@pack.add(f"WITH {_N} SELECT state, next_state, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 4) AS p FROM n")
def tr5_induced_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj = trajectory(spark, sf_dir)
    return tr.induced_chain(tr.policy(traj), tr.action_transitions(traj))


@pack.add(f"""WITH {TRAJECTORY}, n AS (SELECT state, action, count(*) AS n, count(*) FILTER (NOT (state = 'error' AND action = 'high') AND state <> 'signup') AS m FROM e WHERE has_next GROUP BY ALL)
SELECT state, action, round(n::DOUBLE / sum(n) OVER (PARTITION BY state), 6) AS p, round(m::DOUBLE / nullif(sum(m) OVER (PARTITION BY state), 0), 6) AS p_masked FROM n""")
def tr6_masked_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups may do nothing (null throughout), errors no costly action."""
    pi = tr.policy(trajectory(spark, sf_dir))
    allowed = pi.filter("NOT (state = 'error' AND action = 'high') AND state <> 'signup'")
    return tr.masked_policy(pi, allowed)


def _taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.hitting_times(trajectory(spark, sf_dir), GOALS, FAILURES)


@pack.add(f"WITH {TAUS} SELECT run_id, n_steps, coalesce(tau_g, -1)::BIGINT AS tau_g, coalesce(tau_f, -1)::BIGINT AS tau_f FROM h")
def tr7_hitting_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taus(spark, sf_dir).select("run_id", "n_steps", F.coalesce("tau_g", F.lit(-1)).cast("long").alias("tau_g"), F.coalesce("tau_f", F.lit(-1)).cast("long").alias("tau_f"))


@pack.add(f"WITH {TAUS} SELECT count(*) AS runs, count(*) FILTER (ok) AS successes, count(*) FILTER (tau_f IS NOT NULL AND NOT ok) AS failures, count(*) FILTER (tau_g IS NULL AND tau_f IS NULL) AS censored, round(count(*) FILTER (ok) / count(*), 6) AS p_success FROM h")
def tr8_success_before_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.success_before_failure(_taus(spark, sf_dir))


@pack.add(f"WITH {TAUS} SELECT round(avg(tau_g) FILTER (ok), 6) AS mean_given_success, round(avg(tau_g), 6) AS mean_given_hit, count(*) FILTER (ok) AS successes, count(*) FILTER (tau_g IS NULL) AS never_hit FROM h")
def tr9_expected_hitting_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.expected_hitting_time(_taus(spark, sf_dir))


@pack.add(f"WITH {TAUS} SELECT count(*) AS runs, round(avg(cost), 4) AS mean_cost, round(min(cost), 4) AS min_cost, round(max(cost), 4) AS max_cost FROM h")
def tr10_expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.expected_cost(trajectory(spark, sf_dir))


@pack.add("""WITH v AS (SELECT CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' WHEN 'N' THEN CASE WHEN l_tax > 0.05 THEN 'uncertain' END END AS verdict FROM lineitem WHERE l_linestatus = 'F')
SELECT count(*) AS claims, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'fail') AS fail, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict IS NULL) AS unverified,
round(count(*) FILTER (verdict = 'fail') / count(*) FILTER (verdict IN ('pass', 'fail')), 6) AS false_rate FROM v""")
def tr11_false_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that say they are finished, and what the return flag says; some are uncertain, some never verified."""
    flag = F.col("l_returnflag")
    verdict = F.when(flag == "A", "pass").when(flag == "R", "fail").when((flag == "N") & (F.col("l_tax") > 0.05), "uncertain")
    return tr.false_completion(table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(verdict.alias("verdict")))


@pack.add(f"""WITH {TRAJECTORY}, s AS (SELECT run_id, state, count(*) AS visits, count(*) FILTER (has_next AND state = next_state) AS again FROM e GROUP BY ALL)
SELECT run_id, sum(visits)::BIGINT AS n_steps, sum(again)::BIGINT AS retries, count(*) FILTER (visits > 1) AS n_revisited, max(visits) AS max_visits FROM s GROUP BY run_id""")
def tr12_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.loops(trajectory(spark, sf_dir))


@pack.add(f"""WITH {TRAJECTORY}, i AS (SELECT run_id, state, step, step - row_number() OVER (PARTITION BY run_id, state ORDER BY step) AS island FROM e),
s AS (SELECT run_id, state, count(*) AS streak, max(step) AS last FROM i GROUP BY run_id, state, island)
SELECT run_id, streak, state FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY streak DESC, last) = 1""")
def tr12_longest_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.longest_streaks(trajectory(spark, sf_dir))


_CHAIN = """edges(state, next_state) AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN 's' || p_size ELSE 's' || (p_size - p_size % 10) END, CASE WHEN p_size % 10 = 0 THEN 's' || p_size WHEN p_size < 10 THEN 's' || ((p_size + 1) % 10) ELSE 's' || p_size END FROM part)"""


@pack.add(f"""WITH RECURSIVE {_CHAIN}, reach(state, other) AS (SELECT state, next_state FROM edges UNION SELECT r.state, e.next_state FROM reach r JOIN edges e ON r.other = e.state),
states AS (SELECT state FROM edges UNION SELECT next_state FROM edges),
m AS (SELECT a.state, a.other FROM reach a JOIN reach b ON a.state = b.other AND a.other = b.state UNION SELECT state, state FROM states),
k AS (SELECT state, min(other) AS class_id, count(DISTINCT other) AS class_size FROM m GROUP BY state),
o AS (SELECT k.class_id, bool_or(k.class_id <> j.class_id) AS leaves FROM reach r JOIN k USING (state) JOIN k j ON j.state = r.other GROUP BY 1),
g AS (SELECT class_id, bool_or(state IN ('s20')) AS goal FROM k GROUP BY 1)
SELECT state, class_id, class_size, NOT coalesce(leaves, false) AS closed, NOT coalesce(leaves, false) AND NOT goal AS stuck FROM k LEFT JOIN o USING (class_id) JOIN g USING (class_id)""")
def tr13_recurrent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as a chain: a cycle of small ones, closed tens, and ways into single states."""
    size = F.col("p_size")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    state = F.when(size < 10, name(size)).otherwise(name(size - size % 10))
    then = F.when(size % 10 == 0, name(size)).when(size < 10, name((size + 1) % 10)).otherwise(name(size))
    edges = table(spark, sf_dir, "part").select(state.alias("state"), then.alias("next_state")).distinct()
    return classes.recurrent_classes(edges, goals=("s20",))


@pack.add(f"WITH {TRAJECTORY} SELECT state, count(*) AS visits, count(*) FILTER (has_next AND state <> next_state) AS leaving, count(*) FILTER (has_next AND state <> next_state) = 0 AS absorbing FROM e GROUP BY state")
def tr14_absorbing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.absorbing(trajectory(spark, sf_dir))


_CLUSTERS = {"signup": "start", "view": "browse", "click": "browse", "purchase": "goal", "error": "failure"}


@pack.add(f"""WITH {_P}, k(state, cluster) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _CLUSTERS.items())})
SELECT p.state, p.next_state, a.cluster AS from_cluster, b.cluster AS to_cluster, n, p FROM p JOIN k a ON a.state = p.state JOIN k b ON b.state = p.next_state WHERE a.cluster <> b.cluster AND p < 0.2""")
def tr15_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = spark.createDataFrame(list(_CLUSTERS.items()), "state string, cluster string")
    return tr.bottlenecks(tr.transition_matrix(trajectory(spark, sf_dir)), clusters, 0.2)


@pack.add(f"WITH {_N} SELECT state, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (next_state NOT IN ('view', 'click')), 0)::BIGINT AS escapes, round(coalesce(sum(n) FILTER (next_state NOT IN ('view', 'click')), 0) / sum(n), 6) AS p_escape FROM n WHERE state IN ('view', 'click') GROUP BY state")
def tr16_escape_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.escape_probability(tr.transition_counts(trajectory(spark, sf_dir)), ("view", "click"))


def _mechanism_sql() -> str:
    return "CASE event_id % 14 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(tr.MECHANISMS)) + " END"


@pack.add(f"""WITH e AS (SELECT user_id, row_number() OVER w AS step, event_type IN ('view', 'click', 'error') AS inside, lead(event_type IN ('view', 'click', 'error')) OVER w AS next_inside, CASE WHEN event_type IN ('view', 'click', 'error') THEN {_mechanism_sql()} END AS mechanism FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY user_id ORDER BY step) AS visit FROM e),
l AS (SELECT *, last_value(mechanism IGNORE NULLS) OVER (PARTITION BY user_id, visit ORDER BY step) AS credit FROM v),
t AS (SELECT coalesce(credit, 'none') AS mechanism, 0 AS used, 1 AS escape FROM l WHERE inside AND NOT next_inside UNION ALL SELECT mechanism, 1, 0 FROM l WHERE mechanism IS NOT NULL)
SELECT mechanism, sum(used)::BIGINT AS used, sum(escape)::BIGINT AS escapes, round(sum(escape) / nullif(sum(used), 0), 6) AS p_escape FROM t GROUP BY mechanism""")
def tr16_escapes_by_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events name a mechanism in ten of fourteen cases: which of them was last before a run left views, clicks and errors."""
    named = F.get(F.array(*map(F.lit, tr.MECHANISMS)), (F.col("event_id") % 14).cast("int"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", named.alias("action"))
    traj = tr.indexed(events, "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"), keep=("action",))
    return tr.escapes_by_mechanism(traj, ("view", "click", "error"))


@pack.add(f"WITH {_N} SELECT state, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (next_state = 'error'), 0)::BIGINT AS entries, round(coalesce(sum(n) FILTER (next_state = 'error'), 0) / sum(n), 6) AS p_fail FROM n WHERE state <> 'error' GROUP BY state ORDER BY p_fail DESC, state LIMIT 3")
def tr17_failure_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.failure_entry(tr.transition_counts(trajectory(spark, sf_dir)), FAILURES, 3)


@pack.add(f"""WITH {TAUS} SELECT run_id, CASE WHEN ok AND cost < 2500 THEN 'reached target' WHEN ok THEN 'reached false completion' WHEN n_steps > 70 THEN 'stuck' WHEN retries >= 15 THEN 'loop' WHEN errors >= 15 THEN 'tool error'
WHEN n_steps % 5 = 0 THEN 'user clarification needed' WHEN n_steps % 5 = 1 THEN 'context missing' WHEN n_steps % 5 = 2 THEN 'wrong decomposition' WHEN n_steps % 5 = 3 THEN 'wrong action' ELSE 'unfinished' END AS outcome FROM h""")
def tr18_outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj = trajectory(spark, sf_dir)
    more = traj.groupBy("run_id").agg(F.count_if(F.col("state") == "error").alias("errors"), F.count_if(F.col("has_next") & F.col("state").eqNullSafe(F.col("next_state"))).alias("retries"), F.sum("cost").alias("cost"))
    runs = tr.hitting_times(traj, GOALS, FAILURES).join(more, "run_id")
    rest = {c: F.col("n_steps") % 5 == k for k, c in enumerate(("user_clarification_needed", "context_missing", "wrong_decomposition", "wrong_action"))}
    flags = {"reached_target": tr.succeeded() & (F.col("cost") < 2500), "reached_false_completion": tr.succeeded(), "stuck": F.col("n_steps") > 70, "loop": F.col("retries") >= 15, "tool_error": F.col("errors") >= 15, **rest}
    return tr.outcome_labels(runs.select("run_id", *[v.alias(k) for k, v in flags.items()])).select("run_id", "outcome")


_PROBLEMS = ("action too divergent", "state incomplete", "false completion", "stuck", "tool misuse", "weak policy", "weak long-range planning", "unheard of")


@pack.add("""WITH k AS (SELECT CASE event_id % 9 WHEN 0 THEN 'action too divergent' WHEN 1 THEN 'state incomplete' WHEN 2 THEN 'false completion' WHEN 3 THEN 'stuck' WHEN 4 THEN 'tool misuse' WHEN 5 THEN 'weak policy' WHEN 6 THEN 'weak long-range planning' WHEN 7 THEN 'unheard of' ELSE 'none' END AS problem FROM events)
SELECT problem, CASE problem WHEN 'action too divergent' THEN 'tighten the action space' WHEN 'state incomplete' THEN 'change the mapper or the state schema' WHEN 'false completion' THEN 'add a verifier' WHEN 'stuck' THEN 'add an escape transition'
WHEN 'tool misuse' THEN 'change the tool description or the parameter schema' WHEN 'weak policy' THEN 'change the system prompt, few-shot examples or training data' WHEN 'weak long-range planning' THEN 'introduce a planner or search' ELSE '-' END AS remedy, count(*) AS n FROM k GROUP BY ALL""")
def tr19_remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.get(F.array(*map(F.lit, _PROBLEMS)), (F.col("event_id") % 9).cast("int")), F.lit("none"))
    return tr.remedies(table(spark, sf_dir, "events").select(kind.alias("problem"))).groupBy("problem", F.coalesce("remedy", F.lit("-")).alias("remedy")).agg(F.count("*").alias("n"))


def _eval(name: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, count(*) AS runs, round(avg(ok::INT), 6) AS success_rate, round(count(*) FILTER (false_claim) / nullif(count(*) FILTER (claimed), 0), 6) AS false_completion_rate, round(avg(tau_g) FILTER (ok), 6) AS mean_hitting_time, round(avg(n_steps), 6) AS mean_steps,
  round(avg(retries), 6) AS mean_retries, round(avg((retries >= 3)::INT), 6) AS loop_rate, round(sum(errors) / sum(n_steps), 6) AS error_rate, round(avg((asked_at IS NOT NULL)::INT), 6) AS intervention_rate, round(avg(asked_at), 6) AS mean_steps_to_question, round(avg(cost), 4) AS mean_cost FROM hh GROUP BY {by})"""


_RUNS = TAUS + """, q AS (SELECT run_id, bool_or(state = 'purchase' AND cost > 5) AS claimed, bool_or(state = 'purchase' AND cost > 5 AND cost <= 10) AS false_claim, min(step) FILTER (state = 'signup') AS asked_at FROM e GROUP BY run_id),
  hh AS (SELECT *, run_id % 3 AS repeat FROM h JOIN q USING (run_id))"""
_EVAL = f"{_RUNS}, {_eval('ev', 'variant')}"


def _evaluation(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """A purchase claims completion; a cheap one is false, a very cheap one was not looked at; a sign-up asks the user."""
    verified = F.when(F.col("cost") > 5, F.col("cost") > 10)
    return tr.evaluation(trajectory(spark, sf_dir).withColumn("repeat", F.col("run_id") % 3), GOALS, FAILURES, "error", F.col("state") == "purchase", verified, F.col("state") == "signup", by)


@pack.add(f"WITH {_EVAL} SELECT * FROM ev")
def tr20_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir)


_UP = {"success_rate": "true"} | dict.fromkeys(("false_completion_rate", "mean_hitting_time", "mean_steps", "mean_retries", "loop_rate", "error_rate", "intervention_rate", "mean_steps_to_question", "mean_cost"), "false")


def _measures(source: str, by: str) -> str:
    one = lambda m, up: f"SELECT {by} '{m}' AS measure, {up} AS up, max({m}) FILTER (variant = 0) AS baseline, max({m}) FILTER (variant = 1) AS value FROM {source}" + (" GROUP BY repeat" if by else "")
    return f"SELECT *, coalesce(CASE WHEN up THEN value > baseline ELSE value < baseline END, false) AS better FROM ({' UNION ALL '.join(one(m, up) for m, up in _UP.items())})"


@pack.add(f"""WITH {_EVAL}, {_eval('er', 'variant, repeat')}, a AS ({_measures('ev', '')}), o AS (SELECT measure, count(*) FILTER (better) AS repeats_better, count(*) AS repeats FROM ({_measures('er', 'repeat,')}) GROUP BY measure),
b AS (SELECT measure, baseline, value, round(value - baseline, 4) AS delta, better, repeats_better, repeats, better AND repeats_better = repeats AS stable FROM a JOIN o USING (measure)) SELECT *, (SELECT bool_and(stable) FROM b) AS all_stable FROM b""")
def tr21_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.verdict(_evaluation(spark, sf_dir), _evaluation(spark, sf_dir, ("variant", "repeat")), 0, 1)


@pack.add(f"""WITH {TRAJECTORY}, r AS (SELECT run_id, variant, (run_id - variant) // 2 AS task, count(*) AS n_steps FROM e GROUP BY ALL), p AS (SELECT task, avg(n_steps) FILTER (variant = 0) AS a, avg(n_steps) FILTER (variant = 1) AS b FROM r GROUP BY task)
SELECT task::BIGINT AS task, round(a, 4) AS baseline, round(b, 4) AS other, round(b - a, 4) AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def j9_baseline_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _taus(spark, sf_dir).withColumn("task", F.floor(F.col("run_id") / 2).cast("long"))
    return tr.paired(per, "task", "variant", "n_steps", 0, 1)


def _power(n: int) -> str:
    steps = ", ".join(f"d{i + 1} AS (SELECT q.next_state AS state, sum(d.p * q.q) AS p FROM d{i} d JOIN q ON q.state = d.state GROUP BY 1)" for i in range(n))
    return f"q AS (SELECT state, next_state, n::DOUBLE / sum(n) OVER (PARTITION BY state) AS q FROM n), d0 AS (SELECT 'signup' AS state, 1.0::DOUBLE AS p), {steps}"


@pack.add(f"WITH {_N}, {_power(8)} SELECT state, round(p, 6) AS p FROM d8")
def tr22_n_step_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("signup", 1.0)], "state string, p double")
    return tr.n_step(tr.transition_matrix(trajectory(spark, sf_dir)), start, 8)


@pack.add("SELECT g AS state FROM (VALUES ('purchase'), ('error'), ('view')) a(g) INTERSECT SELECT event_type FROM events WHERE value > 400")
def set2_goal_failure_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = spark.createDataFrame([("purchase",), ("error",), ("view",)], "state string")
    return ranking.overlap(goals, table(spark, sf_dir, "events").filter("value > 400").select(F.col("event_type").alias("state")))


@pack.add("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d)
SELECT user_id, strftime(min(day), '%Y-%m-%d') AS start, count(*) AS length FROM i GROUP BY user_id, island""")
def win5_daily_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.streaks(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "length")
