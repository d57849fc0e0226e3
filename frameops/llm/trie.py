"""Prefix trie of conversations, rolled up over a centroid decomposition of its parent edges.

A node is a distinct sequence of first turns; it is named by its smallest member and its depth. Prefixes are told apart by sums of
hashes of (place, turn), 128 bits wide, so that a conversation of any length is hashed by running totals and not in one task.

Rollup. A node's weight is the number of turns at and below it over all its members, which the grouping of the prefixes gives
without a pass over the tree. Each round takes every component of the forest at once. Nodes with at least half of a component's
weight form a path from its top down; the lowest one is the centroid. The total of the centroid's part is added to every node of
that path, the weight is taken off it, the centroid is done, and its children become tops of components of their own. Each
component has at most half of the weight of the one it came from, so the rounds are as many as the weight has binary digits, be
the forest a bush or a single chain. A node finds the child of the centroid above it by a join on its smallest member: of that
member's path only the part that smaller members own is looked up. Components of at most ``TASK_WEIGHT`` go on in one task each,
by the same steps on arrays.

Defined results: turns are ordered by number (null first), then by a hash of role and text; null role or text is empty; rows
without conv_id are left out; repeated rows are turns of their own. An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm.jaccard import whole_runs
from frameops.llm.tables import Scratch
from frameops.operators.scale import running_totals

#: Weight of the components that one task decomposes on its own.
TASK_WEIGHT = 4096
#: Turns that a rebuilt conversation takes from another one are fewer than ``SHARED``; conversations share in groups of ``GROUP``.
SHARED, GROUP = 9, 5
_TOP = ["top_conv", "top_depth"]
_STATE = [*_TOP, "conv_id", "depth", "parent_conv_id", "first", "host", "weight", "leaf", "saved", "sum_leaf", "sum_saved"]


def rebuild(scratch: Scratch, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, digest, bytes, length), and conversations (conv_id, length), written."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    ranked = running_totals(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.col("digest")], {"place": F.lit(1).cast("long")})
    ranked = scratch.keep(ranked.drop("turn"), "ranked")
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    convs = ranked.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "shared": shared})
    heads = ranked.where(F.col("place") < SHARED).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("place", "digest", "bytes")).alias("head"))
    taken = F.filter("head", lambda x: x.place <= F.col("shared"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(taken, F.expr("array()").cast(heads.schema["head"].dataType)))
    length = F.size("head") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    convs = scratch.keep(convs.select("conv_id", "shared", "head", F.size("head").cast("long").alias("taken"), length.cast("long").alias("length")), "convs")
    begun = convs.select("conv_id", "length", F.inline("head"))
    own = ranked.join(convs.select("conv_id", "shared", "taken", "length"), "conv_id").where("place > shared")
    own = own.withColumn("place", F.col("taken") + F.col("place") - F.col("shared"))
    columns = ["conv_id", "place", "digest", "bytes", "length"]
    return begun.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "length")


def _named(turns: DataFrame) -> DataFrame:
    """Turns with the hash (k1, k2) of the sequence up to each."""
    one, two = F.xxhash64("place", "digest"), F.xxhash64("digest", "place")
    halves = [one.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(one, 32), two.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(two, 32)]
    sums = {f"s{i}": half for i, half in enumerate(halves)}
    summed = running_totals(turns, ["conv_id"], [F.col("place")], sums)
    return summed.select("conv_id", "place", "bytes", "length", F.xxhash64("place", *sums).alias("k1"), F.xxhash64(*reversed(sums), "place").alias("k2"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, decomposed together on arrays."""
    for table in whole_runs(batches, _TOP):
        col = {c: table[c].to_numpy().copy() for c in _STATE}
        n = table.num_rows
        depth, weight = col["depth"], col["weight"]
        place = {key: i for i, key in enumerate(zip(col["conv_id"].tolist(), depth.tolist()))}
        top = np.array([place[key] for key in zip(col["top_conv"].tolist(), col["top_depth"].tolist())])
        parent = np.array([place.get(key, -1) for key in zip(col["parent_conv_id"].tolist(), (depth - 1).tolist())])
        is_top = top == np.arange(n)
        parent = np.where(is_top, np.arange(n), parent)
        # places by weight: a subtree is a range that starts at its node
        below = np.zeros(n, np.int64)
        np.add.at(below, parent[~is_top], weight[~is_top])
        order = np.argsort(parent, kind="stable")
        order = order[~is_top[order]]
        before = np.cumsum(weight[order]) - weight[order]
        before -= before[np.searchsorted(parent[order], parent[order])]
        step = np.zeros(n, np.int64)
        step[order] = (weight - below)[parent[order]] + before
        jump = parent.copy()
        while (jump != top).any():
            step, jump = step + step[jump], jump[jump]
        base = np.zeros(n, np.int64)
        base[is_top] = np.cumsum(weight[is_top]) - weight[is_top]
        begin = base[top] + step
        end = begin + weight
        span = int(weight[is_top].sum()) + 1
        by_depth = np.argsort(depth * span + begin)
        sorted_key = (depth * span + begin)[by_depth]

        alive = np.arange(n)
        while len(alive):
            chain = alive[2 * weight[alive] >= weight[top[alive]]]
            lowest = chain[np.lexsort((weight[chain], top[chain]))]
            lowest = lowest[np.concatenate([[True], top[lowest[1:]] != top[lowest[:-1]]])]
            centroid = np.zeros(n, np.int64)
            centroid[top[lowest]] = lowest
            own = centroid[top[alive]]
            inside = (begin[own] <= begin[alive]) & (begin[alive] < end[own])
            for value, total in (("leaf", "sum_leaf"), ("saved", "sum_saved")):
                part = np.zeros(n, np.int64)
                np.add.at(part, own[inside], col[value][alive[inside]])
                col[total][chain] += part[centroid[top[chain]]]
            taken = weight[centroid[top[chain]]]
            weight[chain] -= np.where(chain == centroid[top[chain]], 0, taken)
            under = alive[inside & (alive != own)]
            key = (depth[centroid[top[under]]] + 1) * span + begin[under]
            top[under] = by_depth[np.searchsorted(sorted_key, key, "right") - 1]
            alive = alive[alive != own]
        yield pa.RecordBatch.from_arrays([pa.array(col[c]) for c in ("conv_id", "depth", "sum_leaf", "sum_saved")], names=["conv_id", "depth", "n_leaves", "saved_tokens"])


def rollup(scratch: Scratch, nodes: DataFrame, paths: DataFrame, task_weight: int = TASK_WEIGHT) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over each node's subtree: conv_id, depth, n_leaves, saved_tokens.

    ``nodes`` is a table of _STATE's node columns. ``paths`` holds, for places of a conversation that a smaller one owns, that
    owner and the owner of the place above (conv_id, place, owner, above).
    """
    done, ready = [], []
    state = nodes
    while True:
        whole = state.groupBy(*_TOP).agg(F.max("weight").alias("whole"))
        state = state.join(whole, _TOP)
        ready.append(state.where(F.col("whole") <= task_weight).select(*_STATE))
        large = state.where(F.col("whole") > task_weight)
        chain = large.where("2 * weight >= whole").groupBy(*_TOP).agg(F.min(F.struct("weight", "conv_id", "depth")).alias("c"))
        chain = scratch.keep(chain.select(*_TOP, F.col("c.weight").alias("c_weight"), F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth")), "centroids")
        if chain.isEmpty():
            break
        large = large.join(chain, _TOP).withColumn("next", F.col("c_depth") + 1)
        asks = (F.col("depth") > F.col("c_depth")) & (F.col("next") < F.col("first"))
        found = large.withColumn("place", F.when(asks, F.col("next"))).join(paths, ["conv_id", "place"], "left")
        child = F.when(asks, F.col("owner")).otherwise(F.col("conv_id"))
        above = F.when(asks, F.col("above")).when(F.col("next") == F.col("first"), F.col("host")).otherwise(F.col("conv_id"))
        is_centroid = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        under = (F.col("depth") > F.col("c_depth")) & (above == F.col("c_conv"))
        found = found.select(*_STATE, "c_weight", "next", child.alias("child"), is_centroid.alias("is_centroid"), under.alias("under"), (2 * F.col("weight") >= F.col("whole")).alias("on_path"))
        found = scratch.keep(found, "split")
        totals = found.where("is_centroid OR under").groupBy(*_TOP).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
        found = found.join(totals, _TOP)
        added = {f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("on_path"), F.col(f"t_{v}")).otherwise(0) for v in ("leaf", "saved")}
        lighter = F.col("weight") - F.when(F.col("on_path") & ~F.col("is_centroid"), F.col("c_weight")).otherwise(0)
        moved = {"top_conv": F.when(F.col("under"), F.col("child")).otherwise(F.col("top_conv")), "top_depth": F.when(F.col("under"), F.col("next")).otherwise(F.col("top_depth"))}
        found = scratch.keep(found.withColumns(added | moved | {"weight": lighter}).select(*_STATE, "is_centroid"), "state")
        done.append(found.where("is_centroid"))
        state = found.where("NOT is_centroid").select(*_STATE)
    rest = ready[0]
    for part in ready[1:]:
        rest = rest.union(part)
    out = rest.repartition(*_TOP).sortWithinPartitions(*_TOP).mapInArrow(_local, "conv_id long, depth long, n_leaves long, saved_tokens long")
    for part in done:
        out = out.union(part.select("conv_id", "depth", F.col("sum_leaf"), F.col("sum_saved")))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node within a batch as one text of ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, depth, conv = (batch[c].to_numpy() for c in ("owner", "depth", "conv_id"))
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])]))
        texts = [",".join(map(str, run.tolist())) for run in np.split(conv, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(depth[first]), pa.array(conv[first]), pa.array(texts)], names=["owner", "depth", "begin", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over the texts of its runs, read one after another."""
    at, state = None, None
    for batch in batches:
        found = []
        for owner, depth, ids in zip(*(batch[c].to_pylist() for c in ("owner", "depth", "ids"))):
            if at == (owner, depth):
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                found.append((*at, state.hexdigest()))
            at, state = (owner, depth), hashlib.sha256(ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["conv_id", "depth", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, task_weight: int = TASK_WEIGHT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuild(scratch, conversations)
    turns = scratch.keep(_named(scratch.keep(turns, "rebuilt")), "prefixes")
    root, n_convs, weight = convs.agg(F.min("conv_id"), F.count("*"), F.sum(F.col("length") + 1)).first()
    same = ["place", "k1", "k2"]
    nodes = turns.groupBy(*same).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("place") + 1).alias("weight"), F.any_value("bytes").alias("bytes"))
    nodes = scratch.keep(nodes, "grouped")
    owned = scratch.keep(turns.join(nodes.select(*same, "owner"), same).select("conv_id", "place", "owner", (F.col("place") == F.col("length")).alias("ends")), "owned")

    paths = owned.where("owner <> conv_id").select("conv_id", "place", "owner")
    over = paths.select("conv_id", (F.col("place") + 1).alias("place"), F.col("owner").alias("above"))
    paths = scratch.keep(paths.join(over, ["conv_id", "place"], "left").withColumn("above", F.coalesce("above", F.lit(root).cast("long"))), "paths")
    hosts = paths.groupBy("conv_id").agg((F.count("*") + 1).alias("first"), F.max_by("owner", "place").alias("host"))
    top = conversations.sparkSession.createDataFrame([(root, 0, n_convs, weight, 0)] if n_convs else [], "conv_id long, depth long, n_convs long, weight long, bytes long")
    nodes = nodes.select(F.col("owner").alias("conv_id"), F.col("place").alias("depth"), "n_convs", "weight", "bytes").union(top)
    nodes = nodes.join(hosts, "conv_id", "left").withColumns({"first": F.coalesce("first", F.lit(1)), "host": F.coalesce("host", F.lit(root).cast("long"))})
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("first"), F.col("host")).otherwise(F.col("conv_id")))
    nodes = scratch.keep(nodes.withColumn("parent_conv_id", parent), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    zero = F.lit(0).cast("long")
    state = nodes.select(
        F.lit(root).cast("long").alias("top_conv"), zero.alias("top_depth"), "conv_id", "depth", "parent_conv_id", "first", "host", "weight",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), zero.alias("sum_leaf"), zero.alias("sum_saved"))
    # the root's parent is null; tops of components never ask for their parent
    state = state.fillna(0, ["parent_conv_id"])
    sums = rollup(scratch, state, paths, task_weight)

    ends = owned.where("ends").select("owner", F.col("place").alias("depth"), "conv_id").union(convs.where("length = 0").select(F.lit(root).cast("long"), zero, "conv_id"))
    ends = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(_chunks, "owner long, depth long, begin long, ids string")
    ends = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "begin").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
