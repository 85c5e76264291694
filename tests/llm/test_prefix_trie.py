import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartledger.llm import prefix_trie as P

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("path", T.LongType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(
                (turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        leaf = [n for n in below if not any(
            len(m) == len(n) + 1 and m[:len(n)] == n for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1]))
                    for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == node)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None,
                    len(members), sum(len(n) == len(node) + 1 for n in below), len(leaf), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, shard_turns=P.SHARD_TURNS):
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS)
    conv = F.col("conv_id")
    got = P.conversation_trie(turns, conv - conv % 20,
                              F.crc32(conv.cast("string").cast("binary")) % 4, 3, shard_turns)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [1, 7, 10_000])
def test_equals_brute_force_at_every_shard_size(spark, shard_turns):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        for d in range(int(rng.integers(0, 7))):
            rows.append((c, d, "ua"[d % 2], f"word {int(rng.integers(2))} of two"))
    assert trie(spark, rows, shard_turns) == by_hand(rows)


def test_a_prefix_that_is_a_conversation_across_shards(spark):
    """Chains in which each conversation goes on from the one before, one a shard."""
    rows = [(20 * c, d, "u", f"t{d} x") for c in range(9) for d in range(c + 1)]
    rows += [(20 * c + 1, d, "u", f"t{d} x") for c in range(9) for d in range(c + 1)]
    for shard_turns in (1, 4, 100):
        assert trie(spark, rows, shard_turns) == by_hand(rows)


def test_nulls_ties_repeats_and_turnless_conversations(spark):
    rows = [(None, 0, "u", "lost"), (1, None, None, None), (1, 0, "u", ""), (1, 0, "u", ""),
            (1, 0, "a", "b"), (1, 0, "a", "a"), (2, 5, None, "x\ty\nz  w"), (3, 1, "u", "only"),
            (7, 0, "a", "b"), (22, 0, "u", "no base"), (23, 0, "u", "no base"), (0, 0, "a", "b"),
            (0, 1, "ab", ""), (19, 0, "a", "bab"), (40, 0, "u", "w " * 300_000)]
    assert trie(spark, rows) == by_hand(rows)
    assert trie(spark, rows, 1) == by_hand(rows)
    assert trie(spark, []) == [] and trie(spark, rows[:1]) == []


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE_IDS", 3)
    rows = [(20 * c, d, "u", f"turn {d}") for c in range(50) for d in range(3)]
    assert trie(spark, rows, 2) == by_hand(rows)


def test_a_long_conversation(spark):
    rows = [(0, d, "u", str(d)) for d in range(3000)]
    got = trie(spark, rows, 100)
    assert len(got) == 3001 and {r[5] for r in got} == {1} and {r[6] for r in got} == {0}


def test_find_close_against_a_stack():
    rng = np.random.default_rng(2)
    for n in (1, 2, 100, 3000):
        depth, bits, opened = 0, [1], 1
        while opened < n or depth + 1:
            go = opened < n and (depth == 0 or rng.random() < 0.55)
            bits.append(int(go))
            opened += go
            depth += 1 if go else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = P.Parentheses(np.array(bits, dtype=np.uint8))
        assert tree.find_close().tolist() == [want[i] for i in tree.opens.tolist()]


def test_lowest_of_ranges():
    values = np.random.default_rng(3).integers(0, 99, 50)
    pairs = [(i, j) for i in range(50) for j in range(i + 1, 51)]
    start, end = np.array(pairs).T
    assert P._lowest(values, start, end).tolist() == [values[i:j].min() for i, j in pairs]
