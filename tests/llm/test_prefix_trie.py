"""The prefix trie against brute force and SQL."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm.shared import stored

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(role, text) for _, role, text in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        if k:
            saved[k] += (len(members[k]) - 1) * len(k[-1][1].encode())
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def rows_of(df, limit=16_384):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.shared_prefixes(df, limit).select(COLUMNS).collect())


def conversations(seed):
    """Few different turns, so that prefixes are shared; gaps, nulls, ties, repeated rows, negative ids, one long conversation, one that many repeat."""
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "", None, "c\nd"]))
    rows = []
    for c in [*range(-13, 60), 1000, 10**12 + 3]:
        if rng.random() < 0.8:
            turns = rng.sample(range(20), rng.randint(1, 9))
            rows += [(c, t, *((("user", "a"), ("assistant", "b"))[k % 2] if rng.random() < 0.7 else pick())) for k, t in enumerate(sorted(turns))]
    rows += [(c, t, "user", "same") for c in range(100, 200) for t in range(4)]
    rows += [(777, t, "user", str(t % 3)) for t in range(2500)]
    rows += [(None, 1, "user", "x"), (5, None, "user", "n"), (5, None, "user", None), (6, 3, "user", "tie"), (6, 3, "user", "tie"), (6, 3, "assistant", "tie")]
    return rows


@pytest.mark.parametrize("limit", [16_384, 40])
def test_trie_equals_brute_force(spark, limit):
    rows = conversations(limit)
    df = stored(spark.createDataFrame([(*r, 0, 9) for r in rows], "conv_id long, turn int, role string, text string, depth int, id int").repartition(3), "trie-test")
    assert rows_of(df, limit) == brute(rows)


def test_trie_equals_sql(spark):
    rows = [r for r in conversations(4) if r[0] != 777]  # SQL walks every pair of an ancestor and a descendant
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.SQL})").fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in found) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert rows_of(df) == []


def test_decomposition_sums_any_tree():
    rng = random.Random(6)
    for n in (1, 2, 3, 50, 400):
        for shape in ("random", "chain", "star", "broom"):
            parent = [-1] + [{"random": rng.randrange(k), "chain": k - 1, "star": 0, "broom": k - 1 if k < n // 2 else n // 2 - 1 if n > 3 else 0}[shape] for k in range(1, n)]
            values = [[rng.randint(-5, 9), 1] for _ in range(n)]
            want, weight = [list(v) for v in values], [rng.randint(1, 4) for _ in range(n)]
            for k in range(n - 1, 0, -1):
                weight[parent[k]] += weight[k]
                want[parent[k]] = [x + y for x, y in zip(want[parent[k]], want[k], strict=True)]
            assert prefix_trie.decomposed(parent, weight, values) == want


def test_a_deep_chain_takes_few_rounds(spark):
    """3,000 turns in one conversation, components of at most 100 nodes: halves at every round."""
    turns = stored(spark.range(1, 3001).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("position"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(3000).cast("long").alias("n_turns")), "trie-chain")
    convs = spark.createDataFrame([(1, 3000), (2, 0)], "conv_id long, n_turns long")
    rows = prefix_trie.nodes_of(turns, convs, 100).collect()
    assert len(rows) == 3001 and {r.n_leaves for r in rows} == {1} and {r.saved_tokens for r in rows} == {0}
    assert {r.depth: (r.n_convs, r.ends_sha256) for r in rows}[0] == (2, hashlib.sha256(b"2").hexdigest())
