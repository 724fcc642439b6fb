"""Repeated passages where an earlier text holds a part of them, or their rarest words elsewhere."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tests.llm.test_operators import repeated_words, words
from trailnote.llm import passages

SCHEMA = "doc_id long, text string"


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def part_held_earlier():
    """In threes: a text with words 1-45 of 55, which is too little, and two with all 55."""
    rng, texts = random.Random(17), {}
    for i in range(0, 600, 3):
        p = words(rng, 55)
        for k, part in enumerate((p[:45], p, p)):
            texts[i + k] = " ".join(words(rng, 60) + part + words(rng, 60))
    return texts


def part_held_twice():
    """In twos: a text with 44 words of a passage, then the passage, and one with the passage."""
    rng, texts = random.Random(19), {}
    for i in range(0, 400, 2):
        p = words(rng, 54)
        texts[i] = " ".join(words(rng, 60) + p[5:49] + words(rng, 60) + p + words(rng, 60))
        texts[i + 1] = " ".join(words(rng, 60) + p + words(rng, 60))
    return texts


def missed(spark, texts):
    got = covered(passages.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect())
    return [k for k, expected in repeated_words(texts).items() if not expected <= got.get(k, set())]


def test_earlier_text_with_a_part_hides_no_repeat(spark):
    assert not missed(spark, part_held_earlier())


def test_first_holders_other_places_hide_no_repeat(spark):
    assert not missed(spark, part_held_twice())


def test_result_is_the_same_in_any_partitions(spark):
    texts = {**part_held_earlier(), **{1000 + k: v for k, v in part_held_twice().items()}}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    one, many = (sorted(map(tuple, passages.repeated_passages(docs.repartition(n)).collect())) for n in (1, 40))
    assert one == many


def test_side_words_tell_many_surroundings_apart():
    rng = random.Random(23)
    texts = [" ".join(words(rng, 300)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(passages._windows(iter([batch])))).to_pylist()
    for side in ("before", "after"):
        places = {(r["doc"], r["c"]): r[side] for r in rows if r[side]}
        assert len(places) > 10_000 and len(set(places.values())) == len(places)


def test_passages_with_a_word_inserted_or_deleted(spark):
    """A word inserted into or deleted from the middle of 56 to 70 words: two shifts, neither half of 50 words."""
    rng, rows, pairs = random.Random(29), [], 300
    for i in range(pairs):
        p = words(rng, 56 + i % 15)
        q = p[: len(p) // 2] + (["put"] if i % 2 else []) + p[len(p) // 2 + (i + 1) % 2 :]
        rows += [(2 * i, " ".join(words(rng, 60) + p + words(rng, 60))), (2 * i + 1, " ".join(words(rng, 60) + q + words(rng, 60)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).filter("source_doc_id = doc_id - 1").select("doc_id").distinct().count()
    assert found >= 0.97 * pairs


def test_unlike_texts_of_one_doc_id(spark):
    """One of them counts; the other is left alone, even where it repeats a passage."""
    rng = random.Random(37)
    p, q = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join(p + words(rng, 20))), (2, " ".join(q + words(rng, 20))), (3, " ".join(words(rng, 10) + p)), (3, " ".join(words(rng, 10) + q)), (3, " ".join(words(rng, 10) + q[:5]))]
    docs = spark.createDataFrame(rows + rows[3:4], SCHEMA)
    out = sorted((r.doc_id, r.text) for r in passages.without_repeats(docs).collect())
    assert len(out) == 6 and out[:2] == rows[:2]
    whole = dict.fromkeys(x for k, x in rows if k == 3)
    assert sum(x not in whole for k, x in out if k == 3) <= 2 and all(any(x in w for w in whole) for k, x in out if k == 3)


def test_fragments_come_in_bounded_batches():
    rng = random.Random(41)
    text = " ".join(words(rng, 20_000))
    wanted = [{"source": 1, "shift": k, "lo": 0, "hi": 10_000} for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([5], pa.int64()), pa.array([text]), pa.array([wanted], pa.list_(pa.struct([("source", pa.int64()), ("shift", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])))], ["doc_id", "text", "wanted"])
    sizes = [sum(map(len, b.column("grams").to_pylist())) for b in passages._fragments(iter([batch]))]
    assert max(sizes) <= passages.HELD + passages.BLOCK and sum(sizes) == 100 * 10_001


def test_stretches_of_runs_equal_all_of_them():
    """Every stretch of runs that is similar enough is covered, wherever it begins, and nothing else is."""
    rng = random.Random(43)
    assert [x[:3] for x in passages.chained([(0, 0, 10), (15, 15, 5), (25, 25, 71)])] == [(0, 100, 0)]
    for _ in range(300):
        runs, f, s = [], 0, 0
        for _ in range(rng.randrange(1, 9)):
            n = rng.randrange(1, 60)
            runs.append((f, s, n))
            f, s = f + n + rng.randrange(1, 12), s + n + rng.randrange(1, 12)
        want = set()
        for i in range(len(runs)):
            for j in range(i, len(runs)):
                shared, ours, theirs = sum(r[2] for r in runs[i : j + 1]), runs[j][0] + runs[j][2] - runs[i][0], runs[j][1] + runs[j][2] - runs[i][1]
                if shared >= 0.8 * (ours + theirs - shared) - 1e-9 and ours + 4 >= 50:
                    want |= set(range(runs[i][0], runs[i][0] + ours + 4))
        got = passages.chained(runs)
        assert {w for a, b, *_ in got for w in range(a, b)} == want
        assert all(x[3] >= 0.8 - 1e-9 for x in got)


def near_cases(rng, pairs):
    """Texts in groups: earlier texts that hold parts, the source, and one with a near copy; (name, group) to (words of the copy)."""
    texts, wanted, at = {}, {}, 0
    cases = {"one of 60": (60, 1, []), "two of 100": (100, 2, []), "two of 100, one part before": (100, 2, [(0, 45)]), "one of 60, one part before": (60, 1, [(0, 45)]), "two of 100, three parts before": (100, 2, [(0, 45), (30, 75), (55, 100)])}
    for name, (size, swaps, parts) in cases.items():
        for _ in range(pairs):
            p = words(rng, size)
            q = list(p)
            # As the contract of similarity 0.8: places at least five words apart, and in reach of it.
            for place in rng.sample(range(5, size - 5, 6), swaps):
                q[place] = "swapped"
            for a, b in parts:
                texts[at] = " ".join(words(rng, 60) + p[a:b] + words(rng, 60))
                at += 1
            texts[at], texts[at + 1] = (" ".join(words(rng, 60) + x + words(rng, 60)) for x in (p, q))
            wanted[(name, at + 1)] = set(range(60, 60 + size))
            at += 2
    return texts, wanted


def test_near_passages_are_found(spark):
    """At random places, with and without earlier texts that hold parts; found: nine tenths of the words are covered."""
    rng = random.Random(47)
    texts, wanted = near_cases(rng, 100)
    got = covered(passages.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect())
    share = {}
    for (name, doc), expected in wanted.items():
        share.setdefault(name, []).append(len(expected & got.get(doc, set())) >= 0.9 * len(expected))
    share = {name: sum(x) / len(x) for name, x in share.items()}
    print(share)
    # Earlier texts that hold parts come first in their groups and hide some near repeats (README has the figures).
    assert all(x >= (0.6 if "before" in name else 0.9) for name, x in share.items()), share


def test_near_passages_are_all_found_behind_their_parts(spark):
    """Every word of near copies is covered by a passage, though earlier texts that hold parts come first in all groups of the copy."""
    rng = random.Random(53)
    texts, wanted = near_cases(rng, 100)
    got = covered(passages.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect())
    short = [k for k, expected in wanted.items() if not expected <= got.get(k[1], set())]
    assert not short


def test_shortest_near_passages_with_a_word_put_in_or_left_out(spark):
    """50 to 55 words: neither side of the place has 50 words, and the shorter one may have no anchor; parts stand before."""
    rng, texts, wanted, at = random.Random(59), {}, {}, 0
    for i in range(200):
        p = words(rng, 51 + i % 5)
        place = rng.randrange(6, len(p) - 6)
        q = p[:place] + (["put"] if i % 2 else []) + p[place + (i + 1) % 2 :]
        for part in (p[:30], p[20:45], p, q):
            texts[at] = " ".join(words(rng, 60) + part + words(rng, 60))
            at += 1
        wanted[at - 1] = set(range(60, 60 + len(q)))
    got = covered(passages.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect())
    assert not [k for k, expected in wanted.items() if not expected <= got.get(k, set())]


def test_near_passage_behind_many_holders_of_its_halves(spark):
    """60 texts hold its first half, 60 its second: its groups are large, and only one earlier text has both halves near each other."""
    rng, texts, wanted, at = random.Random(61), {}, {}, 0
    for _ in range(5):
        p, q = words(rng, 45), words(rng, 45)
        for i in range(120):
            texts[at] = " ".join(words(rng, 60) + (q if i % 2 else p) + words(rng, 60))
            at += 1
            if i in (40, 100):
                texts[at] = " ".join(words(rng, 60) + p + ["one" if i == 40 else "other"] + q + words(rng, 60))
                if i == 100:
                    wanted[at] = set(range(60, 60 + 91))
                at += 1
    got = covered(passages.repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(7)).collect())
    assert not [k for k, expected in wanted.items() if not expected <= got.get(k, set())]


def test_copies_repeat_their_first_text_whole(spark):
    rng = random.Random(67)
    long, short = " ".join(words(rng, 80)), " ".join(words(rng, 30))
    rows = [(i, long) for i in range(30)] + [(i, short) for i in range(30, 40)] + [(40, None), (41, None), (42, ""), (None, long)]
    got = passages.repeated_passages(spark.createDataFrame(rows + rows[5:8], SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 80, 0, 0, 1.0) for i in range(1, 30)]


def test_meetings_are_the_same_in_any_batches():
    """Groups of 1 to 40 anchors, cut into batches anywhere: all pairs of small groups, those with the first of large ones."""
    rng, rows = random.Random(71), []
    for key in range(60):
        rows += [(key, doc, 20, 60, 5, 7) for doc in sorted(rng.sample(range(100), rng.choice((1, 2, 9, 10, 40))))]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), *[pa.int32()] * 4))]
    batch = pa.RecordBatch.from_arrays(columns, passages._ANCHOR)

    def met(size):
        at, held = passages.MEETING, []
        try:
            passages.MEETING = size
            for out in passages._meetings(batch.slice(i, size) for i in range(0, len(rows), size)):
                held += [(r["key"], r["doc"], r["source"]) for r in out.to_pylist()]
        finally:
            passages.MEETING = at
        return sorted(held, key=str), len(held)

    want = met(len(rows) + 1)
    assert set(want[0]) == set(met(1)[0]) == set(met(7)[0]) == set(met(64)[0])
    by = {}
    for key, doc, *_ in rows:
        by.setdefault(key, []).append(doc)
    pairs = set()
    for key, docs in by.items():
        for i, doc in enumerate(docs):
            large = len(docs) > passages.NEAR + 1
            pairs |= {(key, doc, e) for e in docs[: min(i, 1) if large else i]}
            pairs |= {(key, doc, None)} if large else set()
    assert set(want[0]) == pairs


def test_anchors_of_one_text_go_no_further():
    """A text that repeats its own anchors gives no rows for longer keys, however its rows are cut into batches."""
    rows = [(key, doc, c, 60, 5, 7) for key, docs in ((1, (4,)), (2, (3, 9)), (3, (8,))) for doc in docs for c in range(0, 3000, 10)]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), *[pa.int32()] * 4))]
    batch = pa.RecordBatch.from_arrays(columns, passages._ANCHOR)
    first, at = (3, 0), passages.MEETING
    pairs = {(2, 9, c, *first) for c in range(0, 3000, 10)}
    again = {(2, doc, c, None, None) for doc in (3, 9) for c in range(0, 3000, 10)}
    try:
        for size in (1, 7, 290, 301, len(rows) + 1):
            passages.MEETING = size
            for more in (True, False):
                out = passages._meetings((batch.slice(i, size) for i in range(0, len(rows), size)), more)
                got = [(r["key"], r["doc"], r["c"], r["source"], r["s_c"]) for x in out for r in x.to_pylist()]
                assert set(got) == (pairs | again if more else pairs)
    finally:
        passages.MEETING = at


def test_pairs_of_all_steps_are_one_scan(spark):
    """However many steps gave pairs, the driver plans one scan and one exchange of them."""
    rng = random.Random(73)
    line = " ".join(words(rng, 60))
    docs = spark.createDataFrame([(i, " ".join(words(rng, 20)) + " " + " ".join([line] * 8)) for i in range(12)], SCHEMA)
    found = passages.candidates(docs)
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan
    assert {r.doc for r in found.collect()} == set(range(1, 12))


def test_equal_runs_of_a_pair_are_one_row():
    """Requests that overlap give each run once, and what is exchanged of a run is one number."""
    rng = np.random.default_rng(79)
    theirs = rng.integers(0, 1 << 31, passages.BLOCK + passages.REACH, dtype=np.int32)
    ours = theirs[20:120].copy()
    ours[[30, 70]] = 0
    # The first of ours is place 0, so by the shift asked for it stands at that place of the source.
    asked = [(9, 5, 0, shift, shift) for shift in (-32, 0, 32)]
    columns = [pa.array(x, t) for x, t in zip(zip(*asked), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    batch = pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tolist()] * 3, pa.list_(pa.int32())) for x in (theirs, ours))], ["doc", "source", "block", "shift", "first", "theirs", "ours"])
    (out,) = passages._equal_runs(iter([batch]))
    (row,) = out.to_pylist()
    unpacked = [(x >> 36, x >> 10 & (1 << 26) - 1, x & 1023) for x in row["runs"]]
    assert (row["doc"], row["source"]) == (9, 5) and unpacked == [(0, 20, 30), (31, 51, 39), (71, 91, 29)]


def test_texts_read_again_are_joined_by_exchange_at_any_size(spark, monkeypatch):
    """Tables of spans and requests grow with the input; copies need not be told apart again."""
    plans, landed = {}, passages.landed

    def noted(df, name, folder=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return landed(df, name, folder)

    monkeypatch.setattr(passages, "landed", noted)
    rng = random.Random(83)
    line, copy = " ".join(words(rng, 60)), " ".join(words(rng, 80))
    texts = [(i, " ".join(words(rng, 20)) + " " + line) for i in range(12)] + [(i, copy) for i in range(12, 15)]
    got = passages.repeated_passages(spark.createDataFrame(texts, SCHEMA)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(i, 20, 80) for i in range(1, 12)} | {(i, 0, 80) for i in (13, 14)}
    for name in ("exact", "fragments"):
        assert "SortMergeJoin" in plans[name] and "holder" not in plans[name]
