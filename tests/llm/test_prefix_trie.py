import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm.prefix_trie import OP12_SQL, component_steps, op12, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """The rows of the trie from its definition, by plain loops."""
    convs = {}
    for c, turn, role, text in turns:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in convs.items()}
    new = {}
    for c, own in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - int(math.fmod(c, 5)), []) if c is not None else []
        new[c] = base[:h] + own[h:]
    if not new:
        return set()
    key = lambda c: (c is None, c or 0)
    nodes = {}
    for c in sorted(new, key=key):
        for d in range(len(new[c]) + 1):
            nodes.setdefault(tuple(new[c][:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        worth = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += worth
    out = set()
    for n, who in nodes.items():
        ends = ",".join("" if c is None else str(c) for c in who if len(new[c]) == len(n))
        out.add((who[0], len(n), nodes[n[:-1]][0] if n else None, len(who), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def talks(n, seed, words=2, longest=12):
    rng = random.Random(seed)
    return [(c, t, rng.choice("ua"), rng.choice(["é", "bb"][:words]) * rng.randint(1, 2)) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("small", [1, 4, 2000])
def test_against_brute_force(spark, small):
    turns = talks(60, small) + [(c, t, "u", "hot") for c in range(100, 130) for t in range(5)] + [(200, t, "u", str(t % 7)) for t in range(150)]
    assert rows_of(prefix_trie(spark.createDataFrame(turns, SCHEMA), small)) == brute(turns)


def test_nulls_ties_and_gaps(spark):
    turns = [(None, 1, "u", "x"), (None, None, None, None), (7, 3, "u", None), (7, 3, "u", "b"), (7, 3, "a", "b"), (7, 3, "a", "b"), (7, None, None, "z"), (5, 0, "u", "x"), (-3, 0, "u", "x"), (12, 1, "u", "x"), (13, 9, "", "")]
    assert rows_of(prefix_trie(spark.createDataFrame(turns, SCHEMA))) == brute(turns)


def test_empty_and_clashing_columns(spark):
    assert rows_of(prefix_trie(spark.createDataFrame([], SCHEMA))) == set()
    turns = spark.createDataFrame([(5, 0, "u", "x", "y", 1)], SCHEMA + ", c string, at long")
    assert rows_of(prefix_trie(turns)) == brute([(5, 0, "u", "x")])


def test_component_steps_on_random_trees():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 700):
        for chain in (0.0, 0.9, 1.0):
            parent = np.array([0] + [i - 1 if rng.random() < chain else rng.integers(0, i) for i in range(1, n)])
            depth, below, want = np.zeros(n, int), np.ones(n, int), rng.integers(0, 9, (n, 2))
            values = want.copy()
            for i in range(1, n):
                depth[i] = depth[parent[i]] + 1
            for i in range(n - 1, 0, -1):
                below[parent[i]] += below[i]
                want[parent[i]] += want[i]
            assert (component_steps(np.zeros(n, int), parent, depth, below, values) == want).all()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op12(spark, sf)) == brute(turns)


def test_sql_against_brute_force(spark, tmp_path):
    turns = talks(40, 9) + [(None, 1, "u", "x"), (None, None, None, None), (75, 3, "u", None), (75, 3, "u", "b"), (75, 3, "a", "b"), (75, None, None, "z"), (77, 0, "u", "x")]
    spark.createDataFrame(turns, SCHEMA).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert set(con.sql(OP12_SQL).fetchall()) == brute(turns)
