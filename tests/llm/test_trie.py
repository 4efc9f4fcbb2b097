import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from huetide.llm import trie
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def brute(convs):
    """Every node of the conversations {conv_id: [(role, text)]}, its sums from its whole subtree."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(m) - 1) * (len(key[-1][1].encode()) if key else 0)
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def of_rows(rows):
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def rebuild(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + convs[c][h:]
    return out


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_like_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = made(trie.op11_conversation_trie(spark, SF))
    assert got == brute(rebuild(of_rows(rows))) and len(got) > 30


def grown(seed):
    """Conversations that share first turns, some with hundreds, some copied."""
    rng = random.Random(seed)
    rows, c = [], 0
    for _ in range(30):
        base = [rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 8, 300]))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            turns = base[: rng.randint(0, len(base))] + [rng.choice("abcdef") * rng.randint(0, 3) for _ in range(rng.randint(0, 4))]
            rows += [(c, k, rng.choice("ux"), t, "x", "y") for k, t in enumerate(turns)]
            c += rng.choice([1, 1, 2, 7])
    return rows


@pytest.mark.parametrize("limit", [8, 200, 1 << 16])
def test_rounds_and_tasks_alike(spark, limit):
    rows = grown(limit)
    turns = trie.written(trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(7)), "turns")
    rounds = []
    assert made(trie.trie(turns, turns.select("conv_id").distinct(), limit, rounds)) == brute(of_rows(rows))
    assert bool(rounds) == (limit < 1 << 16) and len(rounds) < 14


def test_weights_halve():
    """A path and a star of thousands of nodes are split in a logarithm of rounds, each sum exact."""
    n = 5000
    path = np.arange(-1, n - 1)
    values = np.stack((np.ones(n, dtype=np.int64), np.arange(n)), axis=1)
    got = trie._split(path, np.arange(n), np.arange(n, 0, -1), values, np.zeros((n, 2), dtype=np.int64))
    assert (got[:, 0] == np.arange(n, 0, -1)).all() and (got[:, 1] == np.cumsum(np.arange(n)[::-1])[::-1]).all()
    star = np.concatenate(([-1], np.zeros(n - 1, dtype=np.int64)))
    got = trie._split(star, np.minimum(np.arange(n), 1), np.concatenate(([n], np.ones(n - 1, dtype=np.int64))), values, np.zeros((n, 2), dtype=np.int64))
    assert got[0].tolist() == values.sum(axis=0).tolist() and (got[1:] == values[1:]).all()


def test_running_sums_over_tasks(spark):
    """One key with most rows, over many tasks."""
    rows = [(7, k, 1) for k in range(900)] + [(c, k, 2) for c in (1, 6, 8, 9) for k in range(10)]
    df = spark.createDataFrame(rows, "key long, at long, x long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = trie.running(df, "key", ["key", "at"], ["x"], ["at"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.key, r.at, r.sum_x) for r in got) == sorted((k, a, (a + 1) * x) for k, a, x in rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "u", "in none", "x", "y"), (5, None, None, None, "x", "y"), (5, None, "u", "ä", "x", "y"), (5, 2, "u", "b" * 100_000, "x", "y"), (6, 1, "u", "same", "x", "y")]
    rows += [(6, 1, "u", "same", "x", "y")] * 3 + [(-7, 0, "u", "", "x", "y"), (-5, 0, None, "", "x", "y"), (8, 1, "a", "z", "x", "y"), (8, 1, "b", "a", "x", "y"), (9, 1, "ab", "c", "x", "y"), (10, 1, "a", "bc", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert made(trie.conversation_trie(df)) == brute(of_rows(rows))
    turns = trie.written(trie.numbered(df), "turns")
    assert made(trie.trie(trie.rebuilt(turns), turns.select("conv_id").distinct())) == brute(rebuild(of_rows(rows)))
    assert trie.conversation_trie(df.where("false")).count() == 0
    assert trie.conversation_trie(df.where("conv_id is null")).count() == 0
