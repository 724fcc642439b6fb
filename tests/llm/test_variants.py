"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from trailnote.llm import queries, variants

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    around = {a: [b for b in n if near(a, b)] for a in n}
    form = {}
    for a, others in around.items():
        if others and n[best := min(others, key=lambda w: (-n[w], w))] >= 5 * n[a]:
            form[a] = best

    def root(a):
        return root(form[a]) if a in form else a

    return sorted((a, form.get(a, ""), root(a), c, len(around[a]), n.get(form.get(a), -1)) for a, c in n.items())


def run(spark, docs, tmp_path):
    spark.createDataFrame([(*d, "w", "m") for d in docs], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(13)
    roots = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "bbaabb", "babaab", "ÀÉÎÕÜÿ×÷"]
    words = []
    for w in roots:
        words += [w] * rng.choice([5, 40, 700])
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1 :]])
            words += [v] * rng.choice([4, 5, 9, 130])
    rng.shuffle(words)
    out = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i::50])) for i in range(50)]
    long = "ab" * 3000
    out += [(60 + i, f"{long}-{long}c {long}") for i in range(5)] + [(70, None), (71, ""), (None, "abcdef " * 6), (72, "\n\t 12345 ab_cd"), out[3], out[3]]
    return out


def test_variants_equal_all_pairs(spark, docs, tmp_path):
    want = plainly(docs)
    assert run(spark, docs, tmp_path) == want
    assert any(f for _, f, *_ in want) and any(r != f and f for _, f, r, *_ in want)


def test_no_words(spark, tmp_path):
    assert run(spark, [(1, None), (2, "too few words here")], tmp_path) == []


def test_pairs_come_once(spark):
    words = spark.createDataFrame([(i, w, 9) for i, w in enumerate(["aaaaaa", "aaaaaaa", "aaabaaa", "aaaaaba", "baaaaaa", "aabaaa", "zzzzzz"])], "wid long, word string, n long")
    pairs = [tuple(r) for r in variants.near_pairs(words).collect()]
    of = {r.wid: r.word for r in words.collect()}
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in of for b in of if near(of[a], of[b])}


def test_joins_of_words_pass_no_driver(spark):
    words = variants.landed(spark.createDataFrame([(1, "letter", 60), (2, "lettre", 5), (3, "leter", 5), (4, "letters", 9)], "wid long, word string, n long"), "words")
    found = variants.grouped(words)
    assert {(r.word, r.root, r.n_near) for r in found.collect()} == {("letter", "letter", 2), ("leter", "letter", 1), ("letters", "letter", 1), ("lettre", "lettre", 0)}
    for frame in (variants.forms(words), found):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
