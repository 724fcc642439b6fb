"""The prefix trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trailnote.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner long"


def plain_trie(rows):
    """Rows of the query from (conv_id, turn, role, text), by walking dictionaries."""
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said.setdefault(conv, []).append((turn is not None, turn or 0, told, role, text))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in said.items()}
    full = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(said.get(c - c % 5, [])[:h] + own[h:])
    members, ending = {}, {}
    for c, v in sorted(full.items()):
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
        ending.setdefault(v, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [sums[q] for q in children.get(p, [])]
        sums[p] = (sum(x for x, _ in below) or 1, own + sum(x for _, x in below))
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children.get(p, [])), *sums[p], hashlib.sha256(",".join(map(str, ending.get(p, []))).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, tmp_path):
    spark.createDataFrame([(c, t, r, x, "deep", 7) for c, t, r, x in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, str(tmp_path)).select("conv_id", "depth", F.coalesce("parent_conv_id", F.lit(-1)), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, got.collect()))


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = []
    for c in range(60):
        base = random.Random(c // 15)  # fifteen conversations begin alike
        turns = [(base.choice(["user", "assistant", None]), base.choice(["a", "é b", "", None, "long " * 9])) for _ in range(rng.randrange(1, 12))]
        if c % 7 == 0:
            turns[-1] = ("user", f"own {c}")
        rows += [(c, t if c % 11 else None, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(100, t, "user", "hot") for t in range(150)] + [(105, t, "user", "hot" if t < 120 else f"x{t}") for t in range(150)]
    rows += rows[5:8] + [(None, 0, "user", "nobody"), (200, None, None, None), (7_000_000_000, 1, "user", "far")]
    return rows


def test_trie_equals_plain_walk(spark, talk, tmp_path, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 16)
    monkeypatch.setattr(prefixes, "NAMES", 4)
    assert run(spark, talk, tmp_path) == plain_trie(talk)


def test_no_conversations(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
