"""Support through a whole lineage, escapes by mechanism, and what moves into the pool."""

import random

from pyspark.sql import functions as F

from trailnote.operators import chains, linkage, review, trajectory as tr


def test_support_counts_shared_evidence_once(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(2)] + [(100, 101), (101, 102), (102, 101), (103, 100), (104, 0), (104, None)]
    items = [(i, rng.randrange(400)) for i in range(60) for _ in range(12)] + [(100, 7), (101, 8), (300, 1), (300, 1), (301, None)]
    own, above = {}, {}
    for i, x in items:
        own.setdefault(i, set()).update({x} - {None})
    for a, b in edges:
        above.setdefault(a, set()).update({b} - {None})

    def whole(i):
        out, todo, seen = set(), [i], set()
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                out |= own.get(k, set())
                todo += above.get(k, ())
        return out

    got = {r.id: r for r in linkage.lineage_support(spark.createDataFrame(edges, "id long, source long"), spark.createDataFrame(items, "id long, item long")).collect()}
    cyclic = {100, 101, 102, 103}
    assert set(got) == {i for e in edges for i in e if i is not None} | set(own)
    assert {i for i, r in got.items() if r.cyclic} == cyclic and all(got[i].level is None for i in cyclic)
    assert got[100].support == 1 and got[102].support == 0
    for i, r in got.items():
        if i not in cyclic:
            assert abs(r.support - len(whole(i))) <= 0.02 * len(whole(i)), i
            assert r.level == max((got[s].level + 1 for s in above.get(i, ())), default=0)


def test_support_of_large_sets_is_within_the_sketch(spark):
    items = spark.range(60_000).select((F.col("id") % 3).alias("id"), F.col("id").alias("item"))
    edges = spark.createDataFrame([(9, 0), (9, 1), (10, 9), (10, 2)], "id long, source long")
    got = {r.id: r.support for r in linkage.lineage_support(edges, items).collect()}
    for i, n in ((0, 20_000), (9, 40_000), (10, 150_000)):
        assert abs(got[i] - n) < 0.04 * n


def test_support_of_nothing(spark):
    assert linkage.lineage_support(spark.createDataFrame([], "id long, source long"), spark.createDataFrame([], "id long, item long")).count() == 0


def test_escapes_are_credited_to_the_last_mechanism_of_the_visit(spark):
    rng = random.Random(5)
    runs = {f"r{k}": [(rng.choice("xyo"), rng.choice([*tr.MECHANISMS[:3], "search", None])) for _ in range(rng.randrange(1, 80))] for k in range(8)}
    rows = [(run, i, s, a) for run, steps in runs.items() for i, (s, a) in enumerate(steps)]
    used, escapes = {}, {}
    for steps in runs.values():
        last = "none"
        for (s, a), after in zip(steps, [*steps[1:], None]):
            if s == "o":
                last = "none"
                continue
            if a in tr.MECHANISMS:
                last = a
                used[a] = used.get(a, 0) + 1
            if after and after[0] == "o":
                escapes[last] = escapes.get(last, 0) + 1
    traj = tr.indexed(spark.createDataFrame(rows, "run string, at long, s string, action string"), "run", ["at"], "s", F.floor(F.col("at") / 16), keep=("action",))
    for width in (10_000, 8):
        got = {r.mechanism: (r.used, r.escapes, r.p_escape) for r in tr.escapes_by_mechanism(traj, ["x", "y"], width).collect()}
        assert got == {m: (used.get(m, 0), escapes.get(m, 0), round(escapes.get(m, 0) / used[m], 6) if m in used else None) for m in used.keys() | escapes.keys()}


def test_pool_moves_fill_the_room(spark):
    items = lambda *x: spark.createDataFrame([(i,) for i in x], "item string")
    recommended = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 2), ("b", 9), (None, 0)], "item string, rank int").filter("item IS NOT NULL")
    weeks = spark.createDataFrame([("w1", 0), ("w2", 1), ("w3", 5)], "week string, room int")
    got = sorted(map(tuple, review.pool_moves(weeks, recommended, items("b"), items("zz")).collect()))
    assert got == [("w2", 1, "c"), ("w3", 1, "c"), ("w3", 2, "d")]


def _plans(monkeypatch, module):
    """The plans of all tables that module lands, as a list that fills."""
    plans, real = [], module.landed

    def landed(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(module, "landed", landed)
    return plans


def test_support_is_exact_for_large_sets(spark):
    """A sketch was exact for a few hundred items only."""
    items = spark.range(30_000).select((F.col("id") % 3).alias("id"), (F.col("id") % 20_011).alias("item"))
    edges = spark.createDataFrame([(9, 0), (9, 1), (10, 9), (10, 2)], "id long, source long")
    got = {r.id: r.support for r in linkage.lineage_support(edges, items).collect()}
    of = lambda *ids: len({i % 20_011 for i in range(30_000) if i % 3 in ids})
    assert got == {0: of(0), 1: of(1), 2: of(2), 9: of(0, 1), 10: 20_011}


def test_chains_are_followed_without_broadcasts(spark, monkeypatch):
    plans = _plans(monkeypatch, linkage)
    ends = linkage.chain_ends(spark.createDataFrame([(i, i - 1 if i % 5 else None) for i in range(40)], "id long, supersedes long"))
    assert {(r.id, r.latest, r.hops) for r in ends.collect()} == {(i, i - i % 5 + 4, 4 - i % 5) for i in range(40)}
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in [*plans, ends._jdf.queryExecution().executedPlan().toString()])


def test_chains_of_states_are_solved_without_broadcasts(spark, monkeypatch):
    plans = _plans(monkeypatch, chains)
    n = spark.createDataFrame([("a", "a", 1), ("a", "g", 1), ("a", "f", 2)], "state string, next_state string, n long")
    found = chains.absorption(n, ["g"], ["f"])
    assert {(r.state, r.p_success) for r in found.collect()} == {("a", round(1 / 3, 6)), ("g", 1.0), ("f", 0.0)}
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])


def _disk(spark):
    """Bytes of what is on its way along edges."""
    from pathlib import Path

    from trailnote.sources.tables import shared_dir

    root = Path(shared_dir(spark).removeprefix("file://"))
    return sum(p.stat().st_size for p in root.glob("trailnote-lineage-s*/**/*.parquet")) if root.exists() else 0


def test_support_by_slices_is_the_same_and_takes_less_disk(spark, monkeypatch):
    """All lineages together hold far more items than the evidence: here 7 levels that all have the items of those below."""
    edges = spark.range(6 * 400).select((F.col("id") + 400).alias("id"), F.explode(F.array(F.col("id"), F.col("id") - F.col("id") % 400 + (F.col("id") + 7) % 400)).alias("source"))
    edges = edges.union(spark.createDataFrame([(5000, 5001), (5001, 5000), (5002, 30), (5002, 5000)], "id long, source long"))
    items = spark.range(7 * 400 * 30).select((F.col("id") / 30).cast("long").alias("id"), (F.col("id") * 7919 % 20_011).alias("item"))
    items = items.union(spark.createDataFrame([(5000, 1), (5000, 2), (5002, 9)], "id long, item long"))
    most, sizes, real = {}, [], linkage.new_folder

    def new_folder(spark, name):
        sizes.append(_disk(spark))
        return real(spark, name)

    monkeypatch.setattr(linkage, "new_folder", new_folder)
    for name, at_once in (("all", 1 << 40), ("slices", 150_000)):
        monkeypatch.setattr(linkage, "LINEAGE_ITEMS", at_once)
        monkeypatch.setattr(linkage, "LINEAGE_SHARE", 0)
        before = _disk(spark)
        sizes.clear()
        got = linkage.lineage_support(edges, items)
        most[name] = max(sizes) - before, sorted(map(tuple, got.collect()), key=str)
    assert most["all"][1] == most["slices"][1] and len(most["all"][1]) == 7 * 400 + 3
    own, above = {}, {}
    for r in items.collect():
        own.setdefault(r.id, set()).add(r.item)
    for r in edges.collect():
        above.setdefault(r.id, set()).add(r.source)
    whole = {}
    for i in range(7 * 400):
        whole[i] = own[i].union(*(whole[s] for s in above.get(i, ())))
    want = [(i, i // 400, len(whole[i]), False) for i in range(7 * 400)] + [(5000, None, 2, True), (5001, None, 0, True), (5002, None, 1, True)]
    assert most["slices"][1] == sorted(want, key=str)
    assert most["slices"][0] < 0.8 * most["all"][0]
