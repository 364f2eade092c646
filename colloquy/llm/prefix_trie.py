"""Prefix trie of conversations as balanced parentheses, a shard at a time.

A node is a sequence of first turns that some conversation begins with. It is told
apart by its depth and by two exclusive-ors of hashes of its turns with their
positions, which are running totals over segments of a conversation: no conversation
is ever gathered. Members, smallest member and children of a node are aggregates.

What a node says about all nodes below it comes from the shape of the trie. Only key
nodes shape it: the root, nodes where a conversation ends, and nodes with several
children; between two of them lies a chain. A leaf's path is its list of key nodes.
If that list has n entries, then n other sequences that begin alike end or branch off
at n depths, so all turns are at least about n * n / 2, and the list is at most about the
root of twice the turns.
Paths are range-partitioned in order, which is an order of the trie's leaves, so
each shard has a run of subtrees and the spines that lead to them. A shard writes its
tries as parentheses: ``(`` where a node begins and ``)`` where its subtree is over.
The excess of opened over closed ones, kept as least values of blocks and of groups of
blocks, finds the parenthesis that closes a node; between the two lie its leaves
(pairs ``()``), counted by rank, and its savings, from cumulative arrays. Nodes on a spine
are in several shards; their parts are added up by node, and each node's own weight
counts in one shard only. Nodes within a chain follow from the key node at its end.

Cases: null role or text is empty; null turns come first; turns of one conversation
with the same number are ordered by a hash of role and text; repeated rows are turns
of their own; a row without ``conv_id`` belongs to no conversation; without any
conversation there is no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.operators.ranking import ranked
from colloquy.session import staged

# Running totals of a conversation are made in segments of this many turns.
SEGMENT = 512
# Parentheses in a block, and blocks in a group of the range min-max structure.
BLOCK = 64
GROUP = 64
HISTORY = 9
FAMILY = 5
SEEDS = (17, 43)
NODE = ("depth", "p0", "p1")


# --- balanced parentheses --------------------------------------------------------


class Parentheses:
    """Balanced parentheses; ``opens`` has true for an opening one."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:len(opens)] = self.excess
        self.low = padded.reshape(blocks, BLOCK).min(axis=1)
        groups = -(-blocks // GROUP)
        padded = np.full(groups * GROUP, np.iinfo(np.int64).max)
        padded[:blocks] = self.low
        self.group_low = padded.reshape(groups, GROUP).min(axis=1)
        # pairs () that begin before a place
        pairs = np.zeros(len(opens) + 1, np.int64)
        if len(opens) > 1:
            pairs[1:-1] = np.cumsum(opens[:-1] & ~opens[1:])
            pairs[-1] = pairs[-2]
        self.pairs = pairs

    def _scan(self, values: np.ndarray, at: np.ndarray, stop: np.ndarray,
              target: np.ndarray) -> np.ndarray:
        """For each query the first place in ``[at, stop)`` where ``values`` is below
        ``target``, ``stop`` without one; all queries step together."""
        found = at.copy()
        open_ = np.flatnonzero(found < stop)
        while len(open_):
            here = found[open_]
            missed = values[here] >= target[open_]
            found[open_[missed]] += 1
            open_ = open_[missed]
            open_ = open_[found[open_] < stop[open_]]
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where the nodes opened at ``at`` are closed: the first later place whose
        excess is below theirs. Blocks and groups with no such place are skipped."""
        target = self.excess[at]
        size, blocks = len(self.opens), len(self.low)
        block = at // BLOCK
        end = np.minimum((block + 1) * BLOCK, size)
        found = self._scan(self.excess, at + 1, end, target)
        far = np.flatnonzero(found >= end)
        if len(far):
            group = block[far] // GROUP
            stop = np.minimum((group + 1) * GROUP, blocks)
            near = self._scan(self.low, block[far] + 1, stop, target[far])
            out = np.flatnonzero(near >= stop)
            if len(out):
                high = self._scan(self.group_low, group[out] + 1,
                                  np.full(len(out), len(self.group_low)), target[far][out])
                first = np.minimum(high * GROUP, blocks)
                near[out] = self._scan(self.low, first, np.full(len(out), blocks),
                                       target[far][out])
            start = np.minimum(near * BLOCK, size)
            found[far] = self._scan(self.excess, start, np.full(len(far), size),
                                    target[far])
        return found

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """How many leaves a node has below itself, or itself if it is one."""
        return self.pairs[close] - self.pairs[at]


def trie(paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses of the trie of ordered paths, and for each opening one where its
    node stands in the paths joined together. Paths are rows of node keys."""
    opens: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    before, start = np.empty((0, 3), np.int64), 0
    for path in paths:
        both = min(len(path), len(before))
        differ = np.flatnonzero((path[:both] != before[:both]).any(axis=1))
        shared = int(differ[0]) if len(differ) else both
        opens.append(np.zeros(len(before) - shared, bool))
        opens.append(np.ones(len(path) - shared, bool))
        nodes.append(np.arange(start + shared, start + len(path)))
        before, start = path, start + len(path)
    opens.append(np.zeros(len(before), bool))
    return np.concatenate(opens), np.concatenate(nodes) if nodes else np.empty(0, int)


# --- turns and nodes -------------------------------------------------------------


def _turn_hash(seed: int) -> Column:
    """Hash of a turn at a position; role and text are kept apart by a length."""
    return F.xxhash64(F.lit(seed), F.col("depth"), F.col("role_size"), F.col("h0"), F.col("h1"))


def turns_in_order(turns: DataFrame, history: int = HISTORY) -> DataFrame:
    """Turns ``(conv_id, place, role_size, h0, h1, size)``, ``place`` from 1, and the
    number ``h`` of turns that its conversation takes from its family's first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(role, text)
    rows = (turns.filter(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("bigint").alias("conv_id"),
                    F.col("turn").cast("bigint").alias("turn"),
                    F.octet_length(role).alias("role_size"),
                    F.xxhash64(F.lit(SEEDS[0]), both).alias("h0"),
                    F.xxhash64(F.lit(SEEDS[1]), both).alias("h1"),
                    F.octet_length(text).cast("bigint").alias("size")))
    order = [F.col("turn").asc_nulls_first(), F.col("role_size"), F.col("h0"), F.col("h1")]
    return (ranked(rows, ["conv_id"], order, "place").drop("turn")
            .withColumn("place", F.col("place") + 1)
            .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % history))


def rebuilt(turns: DataFrame, history: int = HISTORY, family: int = FAMILY) -> DataFrame:
    """Turns of the rebuilt conversations ``(conv_id, depth, role_size, h0, h1, size)``;
    each conversation also has a row of depth 0."""
    placed = staged(turns_in_order(turns, history), "placed-turns")
    body = ["role_size", "h0", "h1", "size"]
    known = placed.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("own"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = (known.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
             .join(bases, "base", "left")
             .withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))))
    convs = staged(convs.select("conv_id", "base", "h", "taken"), "conversations")
    # at most history - 1 turns of a base, each for at most `family` conversations
    first = placed.filter(F.col("place") < history).select(
        F.col("conv_id").alias("base"), F.col("place").alias("depth"), *body)
    given = (convs.filter("taken > 0").join(first, "base")
             .filter(F.col("depth") <= F.col("taken")).select("conv_id", "depth", *body))
    moved = convs.select(F.col("conv_id").alias("owner"), "taken")
    own = (placed.filter(F.col("place") > F.col("h"))
           .join(moved, F.col("conv_id") == F.col("owner"))
           .withColumn("depth", F.col("place") - F.col("h") + F.col("taken"))
           .select("conv_id", "depth", *body))
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"),
                         F.lit(0).alias("role_size"),
                         *[F.lit(0).cast("bigint").alias(c) for c in body[1:]])
    return given.unionByName(own).unionByName(roots)


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Turns with what tells their node apart: ``(conv_id, depth, p0, p1, q0, q1, size,
    reach, last)``; ``q`` is the parent's, ``reach`` the bytes of all turns so far,
    ``last`` says that the conversation ends here."""
    top = F.col("depth") == 0
    rows = rows.select(
        "conv_id", "depth", "size", F.floor(F.col("depth") / SEGMENT).alias("segment"),
        *[F.when(top, F.lit(0)).otherwise(_turn_hash(s)).alias(f"t{i}")
          for i, s in enumerate(SEEDS)])
    sums = {"p0": F.bit_xor("t0"), "p1": F.bit_xor("t1"), "reach": F.sum("size")}
    # long conversations: segments within groups of segments
    rows = rows.withColumn("stretch", F.floor(F.col("segment") / SEGMENT))
    parts = rows.groupBy("conv_id", "stretch", "segment").agg(
        *[v.alias(k) for k, v in sums.items()], F.max("depth").alias("end"))
    wide = parts.groupBy("conv_id", "stretch").agg(
        *[F.bit_xor(k).alias(k) if k != "reach" else F.sum(k).alias(k) for k in sums],
        F.max("end").alias("end"))

    def before(table: DataFrame, group: list[str], by: str, mark: str) -> DataFrame:
        over = Window.partitionBy(*group).orderBy(by).rowsBetween(
            Window.unboundedPreceding, -1)
        return table.select(*group, by, *[F.coalesce(
            (F.sum(k) if k == "reach" else F.bit_xor(k)).over(over),
            F.lit(0)).alias(f"{mark}_{k}") for k in sums])

    ends = wide.groupBy("conv_id").agg(F.max("end").alias("end"))
    start = (before(parts, ["conv_id", "stretch"], "segment", "a")
             .join(before(wide, ["conv_id"], "stretch", "b").join(ends, "conv_id"),
                   ["conv_id", "stretch"])
             .select("conv_id", "stretch", "segment", "end",
                     *[(F.col(f"a_{k}") + F.col(f"b_{k}") if k == "reach" else
                        F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))).alias(f"s_{k}")
                       for k in sums]))
    within = Window.partitionBy("conv_id", "stretch", "segment").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.select("*", *[v.over(within).alias(f"w_{k}") for k, v in
                              {"p0": F.bit_xor("t0"), "p1": F.bit_xor("t1"),
                               "reach": F.sum("size")}.items()])
    rows = rows.join(start, ["conv_id", "stretch", "segment"]).select(
        "conv_id", "depth", "size", "t0", "t1", (F.col("depth") == F.col("end")).alias("last"),
        F.col("w_p0").bitwiseXOR(F.col("s_p0")).alias("p0"),
        F.col("w_p1").bitwiseXOR(F.col("s_p1")).alias("p1"),
        (F.col("w_reach") + F.col("s_reach")).alias("reach"))
    return rows.select("conv_id", "depth", "p0", "p1",
                       F.col("p0").bitwiseXOR(F.col("t0")).alias("q0"),
                       F.col("p1").bitwiseXOR(F.col("t1")).alias("q1"),
                       "size", "reach", "last")


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes with members, smallest member, ends, children and whether they are key."""
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if(F.col("last")).alias("n_ends"), F.first("size").alias("size"),
        F.first("reach").alias("reach"), F.first("q0").alias("q0"),
        F.first("q1").alias("q1"))
    nodes = staged(nodes, "trie-nodes")
    children = (nodes.filter("depth > 0")
                .groupBy((F.col("depth") - 1).alias("depth"), F.col("q0").alias("p0"),
                         F.col("q1").alias("p1"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    return (nodes.join(children, list(NODE), "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
            .withColumn("key", (F.col("n_children") != 1) | (F.col("n_ends") > 0)
                        | (F.col("depth") == 0)))


# --- what lies below a node ------------------------------------------------------


def leaf_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Key nodes of each leaf's path, from the root, as one array ``path``. A node's own
    weight counts on the path of its ``owner``, the smallest leaf below it."""
    key = nodes.filter("key")
    leaves = key.filter("n_children = 0").select(F.col("conv_id").alias("leaf"))
    on_path = (rows.select("conv_id", *NODE)
               .join(leaves, F.col("conv_id") == F.col("leaf")).drop("leaf")
               .join(key.select(*NODE, "reach", "n_convs"), list(NODE)))
    on_path = staged(on_path, "key-turns")
    owners = on_path.groupBy(*NODE).agg(F.min("conv_id").alias("owner"))
    entry = F.struct("depth", "p0", "p1", "reach", "n_convs",
                     (F.col("owner") == F.col("conv_id")).alias("own"))
    return (on_path.join(owners, list(NODE)).groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(entry)).alias("path")))


def below(paths: DataFrame) -> DataFrame:
    """For each key node ``(depth, p0, p1, n_leaves, deeper)``: the leaves below it and
    what all deeper nodes of its subtree save."""
    order = F.transform("path", lambda n: F.struct(n["p0"], n["p1"]))
    placed = (paths.withColumn("_order", order)
              .repartitionByRange("_order").sortWithinPartitions("_order").select("path"))
    ddl = "depth bigint, p0 bigint, p1 bigint, n_leaves bigint, deeper bigint"

    def work(columns: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        depth, p0, p1, reach, members, own = columns
        keys = np.column_stack([depth, p0, p1])
        paths = [keys[a:b] for a, b in zip(ends[:-1], ends[1:])]
        opens, nodes = trie(paths)
        shape = Parentheses(opens)
        at = np.flatnonzero(opens)
        close = shape.find_close(at)
        # the chain that ends at a node, from below its upper key node
        above = np.concatenate([[0], reach[:-1]])
        above[ends[:-1]] = 0
        saved = (members - 1) * (reach - above)
        # a node of several paths is opened once; its weight counts if one is its owner's
        first = np.zeros(len(keys), np.int64)
        first[nodes] = 1
        serial = np.empty(len(keys), np.int64)
        stack = np.empty(int(np.diff(ends).max(initial=0)), np.int64)
        count = np.cumsum(first) - 1
        for a, b in zip(ends[:-1], ends[1:]):
            new = first[a:b] > 0
            stack[:b - a] = np.where(new, count[a:b], stack[:b - a])
            serial[a:b] = stack[:b - a]
        owned = np.zeros(len(nodes), np.int64)
        np.maximum.at(owned, serial, own.astype(np.int64))
        weight = np.zeros(len(opens) + 1, np.int64)
        weight[at + 1] = saved[nodes] * owned
        total = np.cumsum(weight)
        return pa.RecordBatch.from_arrays([
            pa.array(depth[nodes]), pa.array(p0[nodes]), pa.array(p1[nodes]),
            pa.array(shape.leaves(at, close)), pa.array(total[close] - total[at + 1])],
            ["depth", "p0", "p1", "n_leaves", "deeper"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a batch of ordered paths is a shard
            if not batch.num_rows:
                continue
            path = batch["path"]
            flat = path.flatten()
            ends = np.concatenate([[0], np.cumsum(path.value_lengths().to_numpy())])
            columns = [flat.field(n).to_numpy(zero_copy_only=False)
                       for n in ("depth", "p0", "p1", "reach", "n_convs", "own")]
            yield work(columns, ends)

    # spines are in several shards
    return (placed.mapInArrow(make, ddl).groupBy(*NODE)
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("deeper").alias("deeper")))


def ends_digests(rows: DataFrame) -> DataFrame:
    """``(depth, p0, p1, ends_sha256)`` of the nodes where conversations end. Ids pass in
    order, one after another, through the digest of their node."""
    ends = rows.filter("last").select(*NODE, "conv_id")
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            columns = [batch[c].to_pylist() for c in (*NODE, "conv_id")]
            for *found, conv in zip(*columns):
                if found != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = found, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*done)], [*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in (*node, digest.hexdigest())],
                [*NODE, "ends_sha256"])

    return ends.mapInArrow(make, "depth bigint, p0 bigint, p1 bigint, ends_sha256 string")


def with_next_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Each node with ``n_leaves``, ``deeper`` and ``reach`` (as ``to``) of the first key
    node at or below it. Nodes with the same smallest member lie on one path, and the
    last of them is a key node."""
    rows = (nodes.join(keys, list(NODE), "left")
            .withColumn("segment", F.floor(F.col("depth") / SEGMENT))
            .withColumn("mark", F.when(F.col("key"), F.struct(
                "n_leaves", "deeper", F.col("reach").alias("to")))))
    later = Window.partitionBy("conv_id", "segment").orderBy(F.col("depth").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    firsts = (rows.filter("key").groupBy("conv_id", "segment")
              .agg(F.min_by("mark", "depth").alias("mark")))
    segments = rows.select("conv_id", "segment").distinct().join(
        firsts, ["conv_id", "segment"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    carried = segments.select("conv_id", "segment", F.last("mark", ignorenulls=True)
                              .over(after).alias("carried"))
    return (rows.withColumn("near", F.last("mark", ignorenulls=True).over(later))
            .join(carried, ["conv_id", "segment"])
            .withColumn("mark", F.coalesce("near", "carried"))
            .drop("n_leaves", "deeper", "near", "carried", "segment")
            .select("*", "mark.*").drop("mark"))


def prefix_trie(turns: DataFrame, history: int = HISTORY, family: int = FAMILY) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    rows = staged(with_prefixes(rebuilt(turns, history, family)), "trie-turns")
    nodes = staged(nodes_of(rows), "trie-shape")
    keys = staged(below(leaf_paths(rows, nodes)), "trie-keys")
    found = with_next_key(nodes, keys)
    own = F.col("n_convs") - 1
    found = found.withColumn("saved_tokens", F.col("deeper") + own * (
        F.col("to") - F.col("reach") + F.col("size")))
    # only the first node of a member's stretch has a parent with another member
    starts = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth")).filter("depth > 0")
    tops = (nodes.join(starts, ["conv_id", "depth"])
            .select(F.col("conv_id").alias("child"), (F.col("depth") - 1).alias("depth"),
                    F.col("q0").alias("p0"), F.col("q1").alias("p1")))
    parents = (tops.join(nodes.select(*NODE, F.col("conv_id").alias("parent")), list(NODE))
               .select(F.col("child").alias("conv_id"),
                       (F.col("depth") + 1).alias("depth"), "parent"))
    return (found.join(parents, ["conv_id", "depth"], "left")
            .join(ends_digests(rows), list(NODE), "left")
            .select("conv_id", "depth",
                    F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
                    .alias("parent_conv_id"),
                    "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
                    "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
                    .alias("ends_sha256")))
