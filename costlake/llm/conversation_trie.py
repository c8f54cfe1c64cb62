"""Prefix trie of conversations as ternary search trees over dictionary-encoded turns.

Turns (role, text) become numbers once, so that a conversation is a short list of numbers; equal lists are one
with its members counted.  Lists are dealt out by range, so a shard holds one stretch of the order of all lists.
Each shard is a ternary search tree: the children of a node form a search tree of their own, and lists are
inserted medians first, which keeps those trees balanced.  Children are numbered after their parents, so one
pass in falling order of numbers, without recursion, adds up members, leaves and savings.

A node in more than one shard is a prefix of the first or the last list of a shard.  Those boundary nodes, two paths a shard,
are merged by their prefix, and their subtree totals follow by pointer doubling: as many small joins as
the depth of the trie has binary digits.  All other nodes are final where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from costlake.llm.common import written

_NODE = ("key binary, parent_key binary, depth long, least long, parent_least long, n_convs long, n_children long, "
         "n_leaves long, saved long, words long, sha string")
_FIELDS = [("key", pa.binary()), ("parent_key", pa.binary()), *[(name, pa.int64()) for name in (
    "depth", "least", "parent_least", "n_convs", "n_children", "n_leaves", "saved", "words")], ("sha", pa.string())]


def encoded(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(``conv_id``, ``seq`` array<struct<id, words>>): the written list of every conversation's turns in order.

    Null turn numbers come first; equal ones follow the digest of their (role, text).  Rows without a
    conversation are left out.
    """
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    rows = turns.where(turns[id_col].isNotNull()).select(
        turns[id_col].cast("long").alias("conv_id"), turns[turn_col].alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    # ids are read back from the written table, so they stay what they are
    dictionary = written(rows.groupBy("digest").agg(F.first("words").alias("words"))
                         .withColumn("id", F.monotonically_increasing_id()), "turns")
    listed = rows.drop("words").join(dictionary, "digest").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words"))).alias("seq"))
    return written(listed.select("conv_id", F.transform(
        "seq", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("seq")), "conversations")


def rebuilt(lists: DataFrame, every: int, taken: Column) -> DataFrame:
    """``lists`` with the first ``taken`` (0 to 3) turns of each conversation c replaced by those of c - c % every."""
    heads = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("head_of"), F.slice("seq", 1, 3).alias("head"))
    both = lists.withColumn("taken", taken.cast("int")).join(
        heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_of"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.slice("seq", 1, 0))
    own = F.slice("seq", F.col("taken") + 1, F.greatest(F.size("seq") - F.col("taken"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("seq"))


def _enders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, conv_id) in order: for every list its members' number, smallest, and the hash of all, as they pass."""
    current, state = None, None
    done: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
            names=["list", "n", "least", "sha"])

    def end() -> None:
        if state is not None:
            done.append((current, state[0], state[1], state[2].hexdigest()))

    for batch in batches:
        for key, conv in zip(batch.column("list").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != current:
                end()
                current, state = key, [1, conv, sha256(str(conv).encode())]
            else:
                state[0] += 1
                state[2].update(b",%d" % conv)
        if len(done) > 10_000:
            yield table()
    end()
    if done:
        yield table()


class Tree:
    """The ternary search tree of one shard; node 0 is the root of all."""

    def __init__(self) -> None:
        self.turn, self.lower, self.higher, self.first = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.ends, self.least, self.sha = [0], [None], [None]

    def child(self, node: int, turn: int, words: int) -> int:
        at, turns = self.first[node], self.turn
        last, side = -1, self.first
        while at >= 0:
            if turn == turns[at]:
                return at
            last, side = at, self.lower if turn < turns[at] else self.higher
            at = side[at]
        fresh = len(turns)
        side[last if last >= 0 else node] = fresh
        for column, value in ((turns, turn), (self.lower, -1), (self.higher, -1), (self.first, -1),
                              (self.parent, node), (self.depth, self.depth[node] + 1), (self.words, words),
                              (self.ends, 0), (self.least, None), (self.sha, None)):
            column.append(value)
        return fresh

    def insert(self, turns: list[int], words: list[int], n: int, least: int, sha: str) -> None:
        node = 0
        for turn, size in zip(turns, words):
            node = self.child(node, turn, size)
        self.ends[node], self.least[node], self.sha[node] = n, least, sha

    def path(self, turns: list[int]) -> dict[int, bytes]:
        """Digest of the prefix of every node on the way of a list."""
        digest, node = blake2b(digest_size=16), 0
        found = {0: digest.digest()}
        for turn in turns:
            node = self.child(node, turn, 0)
            digest.update(turn.to_bytes(8, "little", signed=True))
            found[node] = digest.copy().digest()
        return found

    def nodes(self, edge: dict[int, bytes]) -> Iterator[tuple]:
        """Rows of all nodes.  Those of ``edge`` count what hangs below them in this shard alone, without other
        ``edge`` nodes and themselves."""
        n, least, parent = list(self.ends), list(self.least), self.parent
        children, leaves, saved = ([0] * len(n) for _ in range(3))
        for i in range(len(n) - 1, -1, -1):
            up = parent[i]
            if i not in edge:
                leaves[i] += children[i] == 0
                saved[i] += (n[i] - 1) * self.words[i]
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
            if up >= 0:
                n[up] += n[i]
                least[up] = least[i] if least[up] is None else min(least[up], least[i])
        for i, up in enumerate(parent):
            yield (edge.get(i), edge.get(up), self.depth[i], least[i], None if i in edge or up in edge else least[up],
                   n[i], children[i], leaves[i], saved[i], self.words[i], self.sha[i])


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, every stretch's middle before its halves."""
    parts = [(0, n)]
    while parts:
        low, high = parts.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            parts += [(middle + 1, high), (low, middle)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists: list[tuple] = []
    for batch in batches:
        seqs = batch.column("seq")
        flat = seqs.flatten()
        turns, words = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        ends = seqs.value_lengths().to_numpy().cumsum().tolist()
        for begun, end, *rest in zip([0, *ends], ends, *[batch.column(c).to_pylist() for c in ("n", "least", "sha")]):
            lists.append((turns[begun:end], words[begun:end], *rest))
    if not lists:
        return
    tree = Tree()
    for i in medians(len(lists)):
        turns, words, *rest = lists[i]
        tree.insert(turns.tolist(), words.tolist(), *rest)
    edge = tree.path(lists[0][0].tolist()) | tree.path(lists[-1][0].tolist())
    lists.clear()
    rows: list[tuple] = []
    for row in tree.nodes(edge):
        rows.append(row)
        if len(rows) == 20_000:
            yield _nodes(rows)
            rows = []
    if rows:
        yield _nodes(rows)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, (_, k) in zip(zip(*rows), _FIELDS)], names=[name for name, _ in _FIELDS])


def _merged(edges: DataFrame) -> DataFrame:
    """Boundary nodes of all shards, one row a prefix, with whole subtrees counted."""
    one = written(edges.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("least").alias("least"),
        F.max("words").alias("words"), F.max("sha").alias("sha"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]), "edges")
    below = one.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = one.join(below, "key", "left").select(
        "key", "parent_key", "depth", "least", "sha", "n_convs", children.alias("n_children"),
        (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    deepest = one.agg(F.max("depth")).first()[0] or 0
    state = written(own.withColumn("jump", F.col("parent_key")), "edges")
    for _ in range(deepest.bit_length()):
        # every node hands its sum to the one as many steps up as it has summed steps down
        gained = state.where("jump is not null").groupBy(F.col("jump").alias("key")).agg(
            F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        state = written(state.join(gained, "key", "left").join(further, "jump", "left").select(
            *[c for c in own.columns if c not in ("n_leaves", "saved")],
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").alias("jump")), "edges")
    return state.drop("jump")


def prefix_trie(lists: DataFrame, turns_a_shard: int = 400_000) -> DataFrame:
    """One row per distinct prefix of the lists (``conv_id``, ``seq``), the empty one included.

    ``conv_id`` is the smallest conversation that starts with it, ``parent_conv_id`` that of the prefix one turn
    shorter; ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` count members, distinct next turns,
    childless nodes and repeated words of the subtree; ``ends_sha256`` hashes the conversations that end there.
    Equal lists are one with all members, so copies do not grow a shard.  No lists give no rows, not even a
    root.  One conversation's ids, 12 bytes a turn, must fit a task; texts never travel behind the dictionary.
    """
    named = lists.select("conv_id", "seq", F.unhex(F.sha2(F.array_join(F.transform(
        "seq", lambda t: t["id"].cast("string")), ","), 256)).alias("list"))
    distinct = named.groupBy("list").agg(F.first("seq").alias("seq"))
    members = named.select("list", "conv_id").repartition("list").sortWithinPartitions("list", "conv_id").mapInArrow(
        _enders, "list binary, n long, least long, sha string")
    whole = written(distinct.join(members, "list").drop("list"), "lists")
    turns = whole.agg(F.sum(F.size("seq"))).first()[0] or 0
    shards = max(-(-turns // turns_a_shard), min(16, turns // 5_000), 1)
    nodes = written(whole.repartitionByRange(shards, "seq").sortWithinPartitions("seq").mapInArrow(_shard, _NODE), "nodes")
    edges = _merged(nodes.where("key is not null"))
    ups = edges.select(F.col("key").alias("parent_key"), F.col("least").alias("up"))
    inner = nodes.where("key is null")
    parts = [
        inner.where("parent_key is null").withColumn("up", F.col("parent_least")),
        inner.where("parent_key is not null").join(ups, "parent_key"),
        edges.join(ups, "parent_key", "left"),
    ]
    columns = [F.col("least").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
               "n_leaves", F.col("saved").alias("saved_tokens"),
               F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))
