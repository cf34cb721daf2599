"""Prefix trie over conversations, from vertical bitmaps.

Method. Conversations are dealt to shards by ranges of their id. Inside a shard every (position, turn) has a bitset of the
conversations that have this turn there, and every length a bitset of those that end there. A depth-first walk from the root
intersects the bitset of a node with the postings of the next position: the lowest conversation not yet placed names the next
child, its bitset is the parent's and the posting's, until none is left. Popcounts are members, the lowest bit is the smallest
member, the intersection with the lengths is the list of those that end. A node's name is the digest of its turns, chained, so
that nodes of different shards meet: counts add up, and the shard of the smallest member owns the node. Sums over subtrees are
differences of running sums in the order of the walk, over the nodes a shard owns, added over shards by name.

Scale. Turns travel as 16-byte digests. A shard holds ``families`` * ``FAMILY`` conversations at most and its bitsets are that
wide; a conversation's digests are held at once, as a text would be. A node that a third of all conversations share costs one
row a shard. Digests of the ends of a node are streamed over its shards in order of ids. The walk's rows are stored once.

Odd cases: turns come in order of ``turn``, null first; rows that share a turn follow by digest of role and text, repeated rows
are turns of their own. A null role or text is empty. Rows without conv_id belong to no conversation and have no node. A
conversation may be rebuilt without turns and then ends in the root. Very long texts are hashed whole. An empty table gives no
rows, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsonde.llm.shared import written

FAMILY, FAMILIES, HEADS = 5, 200, 9
Turn = tuple[bytes, int]
WALK = "shard long, pre long, last long, up long, node binary, depth long, least long, n long, ended long, ends string, size long"
SUMS = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def rebuilt(own: dict[int, list[Turn]], family: int = FAMILY) -> dict[int, list[Turn]]:
    """Every conversation with the head of the first of its family in place of its own."""
    out = {}
    for c, turns in own.items():
        head = zlib.crc32(b"%d" % c) % HEADS
        out[c] = own.get(c - c % family, [])[:head] + turns[head:]
    return out


def walk(convs: dict[int, list[Turn]]) -> Iterator[tuple]:
    """Nodes in depth-first order: (parent's number, name, depth, members' bitset, ends' bitset, bytes of the last text, ids by bit)."""
    ids = sorted(convs)
    turns = [convs[c] for c in ids]
    postings: list[dict[Turn, int]] = [{} for _ in range(max(map(len, turns)))]
    lengths: dict[int, int] = {}
    for k, t in enumerate(turns):
        bit = 1 << k
        lengths[len(t)] = lengths.get(len(t), 0) | bit
        for place, turn in zip(postings, t):
            place[turn] = place.get(turn, 0) | bit
    stack = [(-1, b"", 0, (1 << len(ids)) - 1, 0)]
    number = 0
    while stack:
        up, name, depth, members, size = stack.pop()
        ended = members & lengths.get(depth, 0)
        yield up, name, depth, members, ended, size, ids
        rest = members & ~ended
        while rest:
            turn = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][turn]
            rest &= ~child
            stack.append((number, hashlib.blake2b(name + turn[0], digest_size=16).digest(), depth + 1, child, turn[1]))
        number += 1


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _walked(group: pd.DataFrame) -> pd.DataFrame:
    shard = int(group["shard"].iloc[0])
    group = group.sort_values(["conv_id", "turn", "key"], na_position="first", kind="stable")
    own: dict[int, list[Turn]] = {}
    for c, key, size in zip(group["conv_id"].tolist(), group["key"], group["size"].tolist()):
        own.setdefault(c, []).append((bytes(key), size))
    rows = [(shard, k, k, up, name, depth, ids[(members & -members).bit_length() - 1], members.bit_count(), ended.bit_count(),
             ",".join(str(ids[b]) for b in _bits(ended)), size) for k, (up, name, depth, members, ended, size, ids) in enumerate(walk(rebuilt(own)))]
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in WALK.split(", ")])
    last, up = out["last"].to_numpy(copy=True), out["up"].to_numpy()
    for k in range(len(out) - 1, 0, -1):
        last[up[k]] = max(last[up[k]], last[k])
    out["last"] = last
    return out


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's share of the sums of each of its nodes; ``total``, ``conv_id`` and ``total_ended`` are those of the whole node."""
    group = group.sort_values("pre")
    up, pre, last = (group[c].to_numpy() for c in ("up", "pre", "last"))
    mine = (group["least"] == group["conv_id"]).to_numpy()
    total, conv = group["total"].to_numpy(), group["conv_id"].to_numpy()
    leaf = mine & (total == group["total_ended"].to_numpy())
    saved = np.where(mine, (total - 1) * group["size"].to_numpy(), 0)

    def below(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values)])
        return run[last + 1] - run[pre]

    below_root = mine & (up >= 0)
    return pd.DataFrame({"node": group["node"], "depth": group["depth"], "conv_id": conv, "parent_conv_id": conv[up],  # the root's is dropped later
                         "n_convs": total, "n_children": np.bincount(up[below_root], minlength=len(group)), "n_leaves": below(leaf.astype(np.int64)),
                         "saved_tokens": below(saved)})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of the ends of each node, from rows in order of node and shard; one running digest is held."""
    name, running = None, None
    for batch in batches:
        out = []
        for node, ends in zip(batch["node"], batch["ends"]):
            node = bytes(node)
            if node != name:
                if running is not None:
                    out.append((name, running.hexdigest()))
                name, running = node, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if running is not None:
        yield pd.DataFrame([(name, running.hexdigest())], columns=["node", "ends_sha256"])


def nodes(conversations: DataFrame, families: int = FAMILIES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("double").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("key"), F.octet_length(text).cast("long").alias("size"))
    turns = turns.withColumn("shard", F.floor(F.col("conv_id") / (FAMILY * families)).cast("long"))
    local = written(turns.groupBy("shard").applyInPandas(_walked, WALK), "trie")
    same = Window.partitionBy("node")
    whole = local.drop("ends").withColumns({"total": F.sum("n").over(same), "total_ended": F.sum("ended").over(same), "conv_id": F.min("least").over(same)})
    sums = whole.groupBy("shard").applyInPandas(_summed, SUMS).groupBy("node").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    ends = local.where("ended > 0").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").mapInPandas(
        _digests, "node binary, ends_sha256 string")
    return sums.join(ends, "node", "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
