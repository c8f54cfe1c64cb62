"""The conversation trie against a walk over every prefix."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from costlake.llm import conversation_trie as ct
from costlake.llm.common import crc_mod

KEY = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, every=20, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(
            (r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / every) * every
        seqs[c] = tuple(own.get(c - base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    member, children = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            member[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in member.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * words
    return sorted((min(who), len(node), min(member[node[:-1]]) if node else -1, len(who), len(children[node]) if node in children else 0,
                   leaves[node], saved[node],
                   sha256(",".join(str(c) for c in sorted(who) if len(seqs[c]) == len(node)).encode()).hexdigest())
                  for node, who in member.items())


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "words", F.lit("clash")).withColumn("depth", F.lit(1)).repartition(4)
    lists = ct.rebuilt(ct.encoded(df), 20, crc_mod(F.col("conv_id"), 4))
    return sorted(tuple(-1 if v is None else v for v in r) for r in ct.prefix_trie(lists, **options).select(*KEY).collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    turns = [f"turn {i} " * rng.randrange(4) for i in range(6)]
    made = []
    for c in [*range(0, 160), -3, -25, 10**12]:
        if c in (40, 60):
            continue
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            made.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(turns + [None])))
    made += [(c, t, "user", f"same {t}") for c in range(200, 400) for t in range(4)]  # many copies
    made += [(401, t, "user", "long " * 3) for t in range(300)]  # a long chain
    made.append((None, 0, "user", "nobody's"))
    return made


def test_every_node_equals_a_plain_walk(spark, rows):
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [40, 150])
def test_boundary_nodes_are_merged_over_many_shards(spark, rows, size):
    assert found(spark, rows, turns_a_shard=size) == brute(rows)


def test_empty_table_has_no_root(spark):
    assert found(spark, []) == []


def test_turnless_conversations_end_at_the_root(spark):
    """Conversation 41 has one turn, takes its first turns from 40, which is absent: nothing is left."""
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = found(spark, [(lone, 0, "user", "gone")])
    assert got == [(lone, 0, -1, 1, 0, 1, 0, sha256(str(lone).encode()).hexdigest())]


def test_repeated_rows_are_turns_of_their_own(spark):
    got = found(spark, [(0, 0, "user", "hi"), (0, 0, "user", "hi")])
    assert [r[1] for r in got] == [0, 1, 2]


def test_median_insertion_keeps_the_search_trees_flat():
    tree = ct.Tree()
    for i in ct.medians(1000):
        tree.insert([i], [1], 1, i, "")
    steps, at = 0, tree.first[0]
    while at >= 0:
        steps, at = steps + 1, tree.higher[at]
    assert sorted(tree.turn[1:]) == list(range(1000)) and steps <= 11
