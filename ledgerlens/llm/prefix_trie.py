"""The prefix trie of conversations, built in range shards by ternary search trees.

Conversations become sequences of turn digests; equal ones are counted before they move.  Sequences are range-partitioned
in order, so a shard holds a contiguous part of the trie.  A shard encodes its digests by a dictionary, inserts its
sequences median first into a ternary search tree, and walks it without recursion.  Only prefixes of a shard's first and
last sequence can go on in a neighbour: these edge nodes are merged by their digest, and what a subtree counted twice is
taken back along each border between two shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, materialize

#: Hexadecimal digits, and bytes, of a turn's digest, cut from SHA-256.
DIGITS = 32
WIDTH = DIGITS // 2
#: Distinct turns of sequences that a shard should hold; ids of members whose text is made at once.
SHARD, RUN = 200_000, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Stands for (role, text), whose border the role's length marks; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, DIGITS)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digests and text sizes of a conversation in the order of turn, null first, then of digests."""
    turn = F.struct("turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rows = conversations.filter("conv_id is not null").select("conv_id", turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % family before its own from the h-th on; h is crc32(c) % heads."""
    first = F.col("conv_id") - F.col("conv_id") % family
    h = (crc32_of(F.col("conv_id").cast("string")) % heads).cast("int")
    head = lists.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head")).filter(f"_first % {family} = 0")
    both = lists.withColumns({"_first": first, "_h": h}).join(head, "_first", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def ends_digests(members: DataFrame) -> DataFrame:
    """(sequence, conv_id) to (sequence, ends_sha256): the digest of a sequence's conv_ids in ascending order, comma-joined.

    Rows are sorted by sequence and id over all tasks, which make runs of text; the runs of a sequence then go through
    one digest in order.  So a sequence with very many members costs its task a row for every RUN of them.
    """
    schema = T.StructType([members.schema["sequence"], T.StructField("first", T.LongType()), T.StructField("told", T.BinaryType())])

    def runs(batches):
        held: list = []  # sequence, first id, ids of the open run

        def close():
            rows = [[held[0]], [held[1]], [",".join(map(str, held[2])).encode()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.binary()))], schema.names)

        for batch in batches:
            sequence, ids = batch.column(0), batch.column(1).to_numpy()
            codes = sequence.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            for lo, hi in zip(cuts, cuts[1:]):
                name = sequence[int(lo)].as_py()
                for at in range(lo, hi, RUN):
                    some = ids[at : min(at + RUN, hi)].tolist()
                    if held and held[0] == name and len(held[2]) + len(some) <= RUN:
                        held[2] += some
                        continue
                    if held:
                        yield close()
                    held[:] = [name, some[0], some]
        if held:
            yield close()

    def digests(batches):
        name, digest = None, None
        for batch in batches:
            out = []
            for sequence, told in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if sequence == name:
                    digest.update(b",")
                else:
                    out += [(name, digest.hexdigest())] if name is not None else []
                    name, digest = sequence, hashlib.sha256()
                digest.update(told)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["sequence", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], ["sequence", "ends_sha256"])

    ordered = members.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    told = ordered.mapInArrow(runs, schema).repartition("sequence").sortWithinPartitions("sequence", "first")
    return told.mapInArrow(digests, "sequence string, ends_sha256 string")


class TernaryTree:
    """Sequences of whole numbers; node 0 is the root, and `then` leads to the search tree of what follows a node."""

    def __init__(self) -> None:
        self.symbol, self.less, self.more, self.then, self.end = [-1], [0], [0], [0], [-1]

    def insert(self, sequence: list[int], value: int) -> None:
        symbol, less, more, then = self.symbol, self.less, self.more, self.then
        at = 0
        for s in sequence:
            links, before = then, at
            node = then[at]
            while node and symbol[node] != s:
                links, before = (less, node) if s < symbol[node] else (more, node)
                node = links[node]
            if not node:
                node = links[before] = len(symbol)
                symbol.append(s)
                for x in (less, more, then):
                    x.append(0)
                self.end.append(-1)
            at = node
        self.end[at] = value

    @classmethod
    def balanced(cls, ordered: list[list[int]]) -> TernaryTree:
        """The median first, then those of both halves, so no search tree of a node is deeper than the logarithm of its sequences."""
        tree, ranges = cls(), [(0, len(ordered))]
        for low, high in ranges:
            if low < high:
                middle = (low + high) // 2
                tree.insert(ordered[middle], middle)
                ranges += [(low, middle), (middle + 1, high)]
        return tree

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes from the root on, parents before children, with their parents (by place in the list) and depths."""
        nodes, parents, depths, open_ = [0], [-1], [0], [(self.then[0], 0)]
        while open_:
            node, parent = open_.pop()
            if not node:
                continue
            open_ += [(self.less[node], parent), (self.more[node], parent), (self.then[node], len(nodes))]
            nodes.append(node)
            parents.append(parent)
            depths.append(depths[parent] + 1)
        return nodes, parents, depths

    def path(self, sequence: list[int]) -> list[int]:
        nodes, at = [0], 0
        for s in sequence:
            at = self.then[at]
            while self.symbol[at] != s:
                at = self.less[at] if s < self.symbol[at] else self.more[at]
            nodes.append(at)
        return nodes


_NODE = "shard int, conv_id long, depth long, above long, above_edge long, edge long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string, size long, on_first boolean, on_last boolean"


def shard_nodes(keys: list[bytes], n: list[int], least: list[int], ends: list[str], sizes: list[list[int]], shard: int) -> pa.RecordBatch:
    """All nodes of the trie of one shard's distinct sequences, given in order.

    above is the parent's smallest member, or above_edge its number where it is an edge node.
    """
    digests = [[k[i : i + WIDTH] for i in range(0, len(k), WIDTH)] for k in keys]
    code = {d: i for i, d in enumerate(sorted(set().union(*digests)))}
    ordered = [[code[d] for d in s] for s in digests]
    tree = TernaryTree.balanced(ordered)
    nodes, parents, depths = tree.walk()
    place = {node: i for i, node in enumerate(nodes)}
    count, low, children, leaves, saved = [0] * len(nodes), [None] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    size, told = [0] * len(nodes), [None] * len(nodes)
    # Any sequence through a node tells its last turn's size: sizes go by digest.
    size_of = {c: b for s, z in zip(ordered, sizes) for c, b in zip(s, z)}
    for i in range(len(nodes) - 1, -1, -1):
        k = tree.end[nodes[i]]
        if k >= 0:
            count[i] += n[k]
            low[i] = least[k] if low[i] is None else min(low[i], least[k])
            told[i] = ends[k]
        if i:
            size[i] = size_of[tree.symbol[nodes[i]]]
        leaves[i] += not children[i]
        saved[i] += (count[i] - 1) * size[i]
        p = parents[i]
        if p >= 0:
            count[p] += count[i]
            low[p] = low[i] if low[p] is None else min(low[p], low[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    edge, key, upper, first, last = ([None] * len(nodes) for _ in range(5))
    for side, k in ((1, len(keys) - 1), (0, 0)):
        digest, before = hashlib.sha256(), None
        for d, node in enumerate(tree.path(ordered[k])):
            i = place[node]
            if d:
                digest.update(digests[k][d - 1])
            own = f"{d}:{digest.hexdigest()}"
            edge[i], key[i], upper[i], before = 2 * d + side, own, before, own
            (last if side else first)[i] = True
    above = [None if p < 0 or edge[p] is not None else low[p] for p in parents]
    above_edge = [None if p < 0 else edge[p] for p in parents]
    columns = [[shard] * len(nodes), low, depths, above, above_edge, edge, count, children, leaves, saved, told, key, upper, size, first, last]
    kinds = [pa.int32(), *[pa.int64()] * 9, pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _NODE.split(", ")])


def _shards(batches):
    keys, n, least, ends, sizes = [], [], [], [], []
    for batch in batches:
        for held, name in ((keys, "key"), (n, "n"), (least, "least"), (ends, "ends_sha256"), (sizes, "sizes")):
            held += batch.column(name).to_pylist()
    if keys:
        nodes = shard_nodes(keys, n, least, ends, sizes, TaskContext.get().partitionId())
        for at in range(0, nodes.num_rows, 10_000):
            yield nodes.slice(at, 10_000)


def merged_edges(edges: DataFrame) -> DataFrame:
    """Edge nodes of all shards to one row a node.

    Sums over shards count a node that goes on in the next shard twice: as a child, as a leaf if its only sequence there
    ends in it, and as a first copy of its text.  The path that two neighbours share is the join of one's last path with
    the other's first, and what it counted twice below a node is a running sum from its deep end.
    """
    after = F.lead("shard").over(Window.orderBy("shard"))  # a row a shard
    borders = edges.filter("depth = 0").select("shard", after.alias("next")).filter("next is not null")
    left = edges.filter("on_last").join(borders, "shard").select("next", "key", "depth", "size", (F.col("n_children") == 0).alias("ends"))
    right = edges.filter("on_first").select(F.col("shard").alias("next"), "key")
    border = Window.partitionBy("next")
    up = border.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    twice = left.join(right, ["next", "key"]).select("key", (F.col("depth") < F.max("depth").over(border)).cast("long").alias("child"), F.max(F.col("ends").cast("long")).over(border).alias("leaf"), F.sum("size").over(up).alias("copy"))
    back = twice.groupBy("key").agg(F.sum("child").alias("child"), F.sum("leaf").alias("leaf"), F.sum("copy").alias("copy"))
    sums = edges.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"))
    less = lambda c, x: (F.col(c) - F.coalesce(x, F.lit(0))).alias(c)
    # n first copies were counted in each shard, but (n - 1) of the whole: what is shared by k shards lacks k - 1 copies.
    more = (F.col("saved_tokens") + F.coalesce("copy", F.lit(0))).alias("saved_tokens")
    return sums.join(back, "key", "left").select("key", "parent_key", "conv_id", "depth", "n_convs", less("n_children", "child"), less("n_leaves", "leaf"), more, "ends_sha256")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """(conv_id, turns of (digest, size)) to a row a node of their trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is one row and its list of turns is held whole; nodes, members and shards may be any number.  No
    conversations give no node, a conversation without turns is a member of the root alone.  A shard holds about
    `shard_turns` turns of distinct sequences; a prefix that many sequences share may span any number of shards.
    """
    spark = sequences.sparkSession
    joined = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = materialize(sequences.select("conv_id", F.unhex(joined).alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")).withColumn("sequence", F.sha2("key", 256)))
    distinct = rows.groupBy("sequence").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = materialize(distinct.join(ends_digests(rows), "sequence"))
    turns = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    parts = distinct.repartitionByRange(int(shards), "key").sortWithinPartitions("key")
    nodes = materialize(parts.select("key", "n", "least", "ends_sha256", "sizes").mapInArrow(_shards, _NODE))
    edges = nodes.filter("edge is not null")
    whole = materialize(merged_edges(edges))
    upper = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    top = whole.join(upper, "parent_key", "left").select("conv_id", "depth", "parent_conv_id", *sums)
    inner = nodes.filter("edge is null")
    plain = inner.filter("above is not null").select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *sums)
    # Children of edge nodes ask within their shard, so no parent of very many children is one key.
    named = edges.join(whole.select("key", F.col("conv_id").alias("parent_conv_id")), "key").select("shard", F.col("edge").alias("above_edge"), "parent_conv_id")
    below = inner.filter("above is null").join(named, ["shard", "above_edge"]).select("conv_id", "depth", "parent_conv_id", *sums)
    return top.unionByName(plain).unionByName(below)


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD) -> DataFrame:
    """Rows (conv_id, turn, role, text) to the nodes of the trie of the rebuilt conversations.

    Null roles and texts are empty, null turns come first, equal turns go by their digest, repeated rows are turns of
    their own, rows without conv_id are no conversation's and give nothing; other columns are ignored.
    """
    return prefix_trie(rebuilt(materialize(turn_lists(conversations))), shard_turns)
