"""Prefix trie of conversations, as balanced parentheses per shard.

1. Each conversation becomes the sequence of its turns' digests (16 bytes a turn, so a prefix of
   turns is a prefix of bytes) and token counts. Equal sequences are one row with their number,
   smallest conversation and the hash of all their ids.
2. Distinct sequences are sorted by a range partitioning of their bytes; runs of about
   ``SHARD_TURNS`` turns are shards. Of neighbours the length of the common prefix is known, so each
   shard knows which of its paths go on in the shard before or behind it: the spines.
3. A shard's trie is a string of parentheses in preorder. findclose, by a tree of block minima of
   the excess, delimits subtrees; the rank of leaf pairs "()" counts leaves; cumulative arrays over
   the preorder give members and savings; sorted (depth, place) pairs give children.
4. All figures add up over shards, because a node that goes on from the shard before counts its own
   tokens, its parent's child and its leaf there only. Spine nodes are summed by the digest of
   their path; all others are final where they are made.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartledger.llm.common import shuffle_partitions, small_side, text_or_empty, written

DIGEST = 16
# Turns of a shard, ids of one packed piece of a member list, bits of a block of excesses.
SHARD_TURNS = 200_000
PIECE_IDS = 400
BITS = 256
_WORD = "[^\\x20\\x09-\\x0D]+"


def conversation_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (array of digest, tokens) in the order of turn
    (null first), then role and text. Rows without conv_id take no part."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("body"))
    # Only rows of one turn are ordered by their texts, and the texts go no further than that.
    tie = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "body"))
    told = F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("body"))
    digest = F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, DIGEST)
    told_rows = rows.select("conv_id", "turn", tie.alias("tie"), digest.alias("digest"),
                            F.regexp_count("body", F.lit(_WORD)).cast("long").alias("tokens"))
    listed = told_rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "tie", "digest", "tokens"))).alias("listed"))
    return listed.select("conv_id", F.transform("listed", lambda t: F.struct(
        t["digest"].alias("digest"), t["tokens"].alias("tokens"))).alias("turns"))


def rebuilt(listed: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Each conversation behind the first ``head`` turns (at most ``most``) of its base
    conversation, in place of its own first ones."""
    rows = listed.select("conv_id", "turns", base.alias("_base"), head.cast("int").alias("_head"))
    bases = rows.select("_base").distinct()
    heads = listed.join(bases, F.col("conv_id") == F.col("_base"), "left_semi").select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first"))
    given = F.coalesce(F.slice("_first", F.lit(1), F.col("_head")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("_head") + 1, F.greatest(F.size("turns"), F.lit(0)))
    return rows.join(heads, "_base", "left").select(
        "conv_id", F.concat(given, own).alias("turns"))


def _pack_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of equal sequences in sorted rows, in pieces of at most PIECE_IDS ids."""
    open_run = None

    def closed(run):
        return {"key": run[0], "first": run[1][0], "n": len(run[1]),
                "ids": ",".join(map(str, run[1])), "path": run[2], "tokens": run[3]}

    for batch in batches:
        out = []
        for key, conv, path, tokens in zip(batch["key"], batch["conv_id"], batch["path"],
                                           batch["tokens"], strict=True):
            if open_run is not None and (open_run[0] != key or len(open_run[1]) >= PIECE_IDS):
                out.append(closed(open_run))
                open_run = None
            if open_run is None:
                open_run = (key, [], path, tokens)
            open_run[1].append(int(conv))
        if out:
            yield pd.DataFrame(out)
    if open_run is not None:
        yield pd.DataFrame([closed(open_run)])


def _join_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sequence from its sorted pieces; ids run through the hash piece by piece."""
    run = None

    def closed(run):
        return {"path": run["path"], "tokens": run["tokens"], "n": run["n"],
                "conv_id": run["conv_id"], "ends": run["hash"].hexdigest()}

    for batch in batches:
        out = []
        for r in batch.itertuples():
            if run is not None and run["key"] == r.key:
                run["hash"].update(b"," + r.ids.encode())
                run["n"] += r.n
                continue
            if run is not None:
                out.append(closed(run))
            run = {"key": r.key, "path": r.path, "tokens": r.tokens, "n": r.n,
                   "conv_id": r.first, "hash": hashlib.sha256(r.ids.encode())}
        if out:
            yield pd.DataFrame(out)
    if run is not None:
        yield pd.DataFrame([closed(run)])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """One row per sequence of turns: path (digests), tokens, n, conv_id (smallest), ends (hash of
    the ids). Ids of one sequence, however many, are packed where they are sorted before they
    meet, and are hashed as a stream."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = convs.select(
        "conv_id", path.alias("path"), F.transform("turns", lambda t: t["tokens"]).alias("tokens"))
    rows = rows.withColumn("key", F.unhex(F.sha2("path", 256)))
    parts = shuffle_partitions(convs.sparkSession)
    pieces = rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions(
        "key", "conv_id").mapInPandas(
            _pack_members, "key binary, first long, n long, ids string, path binary, "
            "tokens array<long>")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInPandas(
        _join_members, "path binary, tokens array<long>, n long, conv_id long, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns at the start of two paths that agree."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    x = np.frombuffer(a[:n * DIGEST], np.uint8) != np.frombuffer(b[:n * DIGEST], np.uint8)
    return int(np.argmax(x)) // DIGEST


def _number_shards(shard_turns: int):
    """Cut sorted sequences into shards; tell each row its common turns with its neighbours (null
    at the ends of the partition)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deal = TaskContext.get().partitionId()
        shard, size, place, held = deal << 32, 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                turns = len(row["path"]) // DIGEST
                if size and size + turns > shard_turns:
                    shard, size = shard + 1, 0
                size += turns + 1
                row |= {"deal": deal, "shard": shard, "place": place, "before": None,
                        "behind": None}
                place += 1
                if held is not None:
                    row["before"] = held["behind"] = common_turns(held["path"], row["path"])
                    out.append(held)
                held = row
            if out:
                yield _sequence_frame(out)
        if held is not None:
            yield _sequence_frame([held])

    return run


_SEQUENCES = ("path binary, tokens array<long>, n long, conv_id long, ends string, deal int, "
              "shard long, place long, before int, behind int")


def _sequence_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"before": "Int32", "behind": "Int32"})


def sorted_sequences(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Sequences in shards of the order of their paths, with the common turns of neighbours."""
    parts = shuffle_partitions(sequences.sparkSession)
    dealt = sequences.repartitionByRange(parts, "path").sortWithinPartitions("path")
    return written(dealt.mapInPandas(_number_shards(shard_turns), _SEQUENCES), "sequences")


def partition_edges(ordered: DataFrame) -> DataFrame:
    """Common turns over the borders of partitions: deal, low (with the partition before, -1 for
    the first), high (with the one behind). Two sequences a partition meet in one small window."""
    first = ordered.filter("before IS NULL").select("deal", F.col("path").alias("first"))
    last = ordered.filter("behind IS NULL").select("deal", F.col("path").alias("last"))
    order = W.orderBy("deal")
    ends = first.join(last, "deal").select(
        "deal", "first", "last", F.lag("last").over(order).alias("_last"),
        F.lead("first").over(order).alias("_first"))

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None or y is None else common_turns(x, y)
                          for x, y in zip(a, b, strict=True)])

    return written(ends.select("deal", common("_last", "first").alias("low"),
                               common("last", "_first").alias("high")), "edges")


class Parentheses:
    """A balanced string of parentheses (1 opens, 0 closes) with range min-max blocks of excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.opens = np.nonzero(bits)[0]
        pairs = (bits[:-1] == 1) & (bits[1:] == 0)
        # Rank of leaf pairs: those that open before a position.
        self.leaves = np.concatenate([[0], np.cumsum(pairs), [pairs.sum()]])
        blocks = -(-len(bits) // BITS)
        padded = np.full(blocks * BITS, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        self.rows = padded.reshape(blocks, BITS)
        # Level 0 has the minimum of every block, each further one that of pairs below.
        self.levels = [self.rows.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, np.iinfo(np.int64).max) if len(low) % 2 else low
            self.levels.append(low.reshape(-1, 2).min(axis=1))

    def find_close(self) -> np.ndarray:
        """The closing position of every opening one: the first behind it with excess one less."""
        at, goal = self.opens, self.excess[self.opens] - 1
        out = np.full(len(at), -1)
        block = at // BITS
        for start in range(0, len(at), 4096):  # inside the own block
            part = slice(start, start + 4096)
            below = (self.rows[block[part]] <= goal[part, None]) & (
                np.arange(BITS)[None, :] > (at[part] % BITS)[:, None])
            hit = below.any(axis=1)
            out[part] = np.where(hit, block[part] * BITS + below.argmax(axis=1), -1)
        todo = np.nonzero(out < 0)[0]
        node, level, target = block[todo].copy(), 0, goal[todo]
        found = np.full(len(todo), -1)
        up = np.ones(len(todo), dtype=bool)
        depth = np.zeros(len(todo), dtype=np.int64)
        while up.any():  # climb until a right neighbour's minimum reaches the goal
            low = self.levels[level]
            right = node + 1
            can = up & (node % 2 == 0) & (right < len(low))
            can[can] = low[right[can]] <= target[can]
            found[can], depth[can] = right[can], level
            up &= ~can
            node, level = node // 2, level + 1
            if level >= len(self.levels):
                break
        for down in range(len(self.levels) - 1, 0, -1):  # descend to the first such block
            now = depth == down
            left = found[now] * 2
            first = self.levels[down - 1][left] <= target[now]
            found[now], depth[now] = np.where(first, left, left + 1), down - 1
        for start in range(0, len(todo), 4096):
            part = slice(start, start + 4096)
            below = self.rows[found[part]] <= target[part, None]
            out[todo[part]] = found[part] * BITS + below.argmax(axis=1)
        return out


def _lowest(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of every range [start, end), by minima of ranges of powers of two."""
    out = np.empty(len(start), dtype=np.int64)
    power = np.frexp(np.maximum(end - start, 1))[1] - 1
    table, width = values, 1
    for k in range(int(power.max()) + 1 if len(power) else 0):
        now = power == k
        out[now] = np.minimum(table[start[now]], table[end[now] - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def prefix_keys(path: bytes, count: int) -> np.ndarray:
    """Names of the first ``count`` nodes of a path: hashes of its prefixes, the empty one first."""
    state, out = hashlib.sha256(), np.empty(count, dtype=object)
    for d in range(count):
        out[d] = state.copy().digest()
        state.update(path[d * DIGEST:(d + 1) * DIGEST])
    return out


_NODES = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
          "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NOBODY = hashlib.sha256(b"").hexdigest()


def shard_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard. ``key`` is set on spine nodes, which other shards have too, and
    ``parent_key`` on the children of such nodes; ends_sha256 is null where none end here."""
    group = group.sort_values("place")
    paths, tokens = group["path"].tolist(), group["tokens"].tolist()
    length = np.array([len(p) // DIGEST for p in paths])
    before, behind = int(group["before"].iloc[0]), int(group["behind"].iloc[-1])
    common = group["before"].to_numpy(np.int64).copy()
    common[0] = 0  # the shard's own trie starts with all of its first path, root included
    opened = length - common
    shut = np.concatenate([[0], length[:-1] - common[1:]])
    runs = np.stack([shut, opened], axis=1).ravel()
    bits = np.repeat(np.concatenate([[1], np.tile([0, 1], len(paths)), [0]]).astype(np.uint8),
                     np.concatenate([[1], runs, [length[-1] + 1]]))
    tree = Parentheses(bits)
    close = tree.find_close()
    at = tree.opens
    nodes = len(at)
    size = (close - at + 1) // 2
    first, last = np.arange(nodes), np.arange(nodes) + size
    depth = tree.excess[at] - 1
    leaves = tree.leaves[close] - tree.leaves[at]
    end = np.cumsum(opened)  # the node at which each sequence ends
    own = np.concatenate([[0]] + [
        np.asarray(t, dtype=np.int64)[c:] for t, c in zip(tokens, common, strict=True)])
    weight = np.zeros(nodes, dtype=np.int64)
    weight[end] = group["n"].to_numpy(np.int64)
    told = np.concatenate([[0], np.cumsum(weight)])
    members = told[last] - told[first]
    # Nodes on the first path down to the common turns with the shard before go on from there.
    goes_on = (first <= before) & (depth == first)
    saved = np.concatenate([[0], np.cumsum(own * (members - ~goes_on))])
    started = np.searchsorted(end, first)
    lowest = _lowest(group["conv_id"].to_numpy(np.int64), started, np.searchsorted(end, last))
    # Nodes by depth, then preorder: children are the next depth's nodes within the subtree.
    place = depth * (nodes + 1) + first
    by_depth = np.sort(place)
    new = np.concatenate([[0], np.cumsum(~goes_on[by_depth % (nodes + 1)])])
    child = (depth + 1) * (nodes + 1)
    children = (new[np.searchsorted(by_depth, child + last)]
                - new[np.searchsorted(by_depth, child + first)])
    parent = by_depth[np.maximum(
        np.searchsorted(by_depth, place - (nodes + 1)) - 1, 0)] % (nodes + 1)
    on_last = last == nodes
    if behind == length[-1]:  # the shard behind goes on from the last leaf
        leaves = leaves - on_last
    shared = goes_on | (on_last & (depth <= behind))
    ends = np.full(nodes, None, dtype=object)
    ends[end] = group["ends"].to_numpy(object)
    ends = np.where((weight == 0) & ~shared, NOBODY, ends)
    key = np.full(nodes, None, dtype=object)
    for path, on_path in ((paths[0], goes_on), (paths[-1], on_last & (depth <= behind))):
        spine = np.nonzero(on_path)[0]  # in the order of depth, from the root
        key[spine] = prefix_keys(path, len(spine))
    parent_key = np.where(depth > 0, key[parent], None)
    open_parent = shared[parent] & (depth > 0)
    return pd.DataFrame({
        "key": key, "parent_key": parent_key, "conv_id": lowest, "depth": depth,
        "parent_conv_id": pd.Series(np.where(open_parent, 0, lowest[parent])).astype("Int64").mask(
            pd.Series(open_parent | (depth == 0))),
        "n_convs": members, "n_children": children, "n_leaves": leaves,
        "saved_tokens": saved[last] - saved[first], "ends_sha256": ends})


def trie_nodes(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of ``convs`` (conv_id, turns: array of digest, tokens).

    One row per distinct sequence of first turns, the root included: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (hash of the ids of the conversations that end there). No conversation, no node.
    """
    ordered = sorted_sequences(written(distinct_sequences(convs), "distinct"), shard_turns)
    edges = F.broadcast(partition_edges(ordered))  # one row per shuffle partition
    known = ordered.join(edges, "deal").withColumn(
        "before", F.coalesce("before", "low")).withColumn("behind", F.coalesce("behind", "high"))
    nodes = written(known.drop("deal", "low", "high").groupBy("shard").applyInPandas(
        shard_nodes, _NODES), "nodes")
    spine = nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("parent_key", ignorenulls=True).alias("parent_key"),
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max("ends_sha256"), F.lit(NOBODY)).alias("ends_sha256"))
    spine = written(spine, "spine")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
               "ends_sha256"]
    whole = nodes.filter("key IS NULL AND parent_key IS NULL").select("parent_conv_id", *columns)
    hung = nodes.filter("key IS NULL AND parent_key IS NOT NULL").select("parent_key", *columns)
    parents = small_side(spine.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    found = hung.unionByName(spine.select("parent_key", *columns)).join(
        parents, "parent_key", "left").select("parent_conv_id", *columns)
    return whole.unionByName(found).select("conv_id", "depth", "parent_conv_id", *columns[2:])


def conversation_trie(turns: DataFrame, base: Column, head: Column, most: int,
                      shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the conversations of ``turns`` (conv_id, turn, role, text), rebuilt from the
    first ``head`` turns of their base conversation; see `trie_nodes` for its columns.

    Null roles and texts are empty; a null turn comes first, and rows of equal turns are ordered by
    role, then text, repeated rows staying. Rows with a null conv_id take no part. A conversation
    left without turns is a member of the root. Texts of any length are only hashed and counted. An
    empty table has no node. Other columns are not read.
    """
    listed = written(conversation_turns(turns), "conversations")
    return trie_nodes(written(rebuilt(listed, base, head, most), "rebuilt"), shard_turns)
