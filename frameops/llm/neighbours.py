"""Near duplicates among embeddings by a forest of random-projection trees with spill.

Equal vectors of a label fall together first and count by their number. A tree splits recursively: a random direction, the
median of the projections as threshold, and a margin around it in which vectors go to both sides. The margin is ``SPILL``
standard deviations of the projected difference of two unit vectors at the least cosine, so that a pair is only parted where
its difference is large and the threshold falls inside it. Trees are fitted on a bounded sample (``SAMPLE_BYTES``); every vector is
then routed through every tree. Within the leaves, vectors of a label are compared by their cosine in double precision, block by
block, so a leaf of any size is compared whole in tasks of bounded size.

A pair that meets in several leaves counts in the first one only: blocks know the leaves of their rows. Blocks return sums of
links and a spanning star of each linked group, never the pairs themselves; the stars are united over all leaves and trees.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or an id,
link with nothing and are their own components. Vectors of different lengths don't link. Repeated rows count as vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.llm.jaccard import whole_runs
from frameops.llm.tables import Scratch, components, smallest_reachable

MIN_COSINE = 0.93
TREES, LEAF_ROWS, SPILL = 6, 512, 1.0
#: A node is split only while each side keeps at most ``MOST_KEPT`` of its rows and the copies along its path stay within ``MOST_COPIES``,
#: so a tree sends a vector to ``MOST_COPIES`` leaves on average at most, however dense a group is.
MOST_KEPT, MOST_COPIES = 0.85, 8.0
#: Bytes of the sample that trees are fitted on, least sample rows of a node, rows of a vector block.
SAMPLE_BYTES, NODE_SAMPLE, BLOCK_ROWS = 16_000_000, 24, 256


class Tree:
    """Nodes in arrays: a direction, a threshold and two children each; a negative child is a leaf."""

    def __init__(self, sample: np.ndarray, rows: int, margin: float, rng: np.random.Generator, leaf: Iterator[int]) -> None:
        self.directions, self.thresholds, self.children = [], [], []
        self.margin = margin
        self.root = self._grow(sample, rows / max(1, len(sample)), 1.0, rng, leaf)

    def _grow(self, sample: np.ndarray, scale: float, copies: float, rng: np.random.Generator, leaf: Iterator[int]) -> int:
        if len(sample) * scale <= LEAF_ROWS or len(sample) < NODE_SAMPLE:
            return -next(leaf)
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        along = sample @ direction
        threshold = float(np.median(along))
        left, right = along <= threshold + self.margin, along >= threshold - self.margin
        copies *= (left.sum() + right.sum()) / len(sample)
        if max(left.sum(), right.sum()) > MOST_KEPT * len(sample) or copies > MOST_COPIES:
            # too dense to part by this margin: its blocks are compared whole
            return -next(leaf)
        node = len(self.directions)
        self.directions.append(direction)
        self.thresholds.append(threshold)
        self.children.append([0, 0])
        self.children[node] = [self._grow(sample[side], scale, copies, rng, leaf) for side in (left, right)]
        return node

    def route(self, vectors: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Rows that reach each leaf."""
        found, waiting = [], [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if node < 0:
                found.append((rows, -node))
                continue
            along = vectors[rows] @ self.directions[node] - self.thresholds[node]
            left, right = self.children[node]
            waiting += [(left, rows[along <= self.margin]), (right, rows[along >= -self.margin])]
        return found


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as unit vectors, and their norms."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # scaled by the largest component, so that neither squares nor their sums overflow
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True), values


def fit_forest(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> dict[int, list[Tree]]:
    """Trees for each vector length, from a sample of ``vectors`` (node, vector, width) that a hash of the node picks."""
    forest, leaf = {}, iter(range(1, 1 << 31))
    sizes = {r.width: r.n for r in vectors.groupBy("width").agg(F.count("*").alias("n")).collect()}
    for width, rows in sorted(sizes.items()):
        wanted = SAMPLE_BYTES // (8 * width)
        chance = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
        chosen = vectors.where((F.col("width") == width) & (chance <= wanted / rows)).select("node", "vector").toArrow()
        units, _ = _units(chosen["vector"].combine_chunks()) if chosen.num_rows else (np.zeros((0, width)), None)
        units = units[np.argsort(chosen["node"].to_numpy(), kind="stable")]
        # a difference of two unit vectors has this length at the least cosine; a random direction sees it divided by sqrt(width)
        margin = SPILL * np.sqrt(2 - 2 * min_cosine) / np.sqrt(width) / 2
        rng = np.random.default_rng([23, width])
        forest[width] = [Tree(units, rows, margin, rng, leaf) for _ in range(TREES)]
    return forest


def _route(forest, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch["width"].to_numpy()
        for width in np.unique(widths):
            rows = pa.array(np.flatnonzero(widths == width))
            part = batch.take(rows)
            units, _ = _units(part["vector"])
            reached = [pair for tree in forest.value[int(width)] for pair in tree.route(units)]
            row = np.concatenate([r for r, _ in reached])
            leaf = np.concatenate([np.full(len(r), k) for r, k in reached])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order].astype(np.int64)
            leaves = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32()), pa.array(leaf))
            part = pa.RecordBatch.from_arrays([*part.columns, leaves], names=[*part.schema.names, "leaves"])
            for low in range(0, len(row), 5000):
                piece = part.take(pa.array(row[low : low + 5000]))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(leaf[low : low + 5000])], names=[*part.schema.names, "leaf"])


def _compare(min_cosine: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, ["family", "leaf", "block"]):
        keys = np.stack([table[c].to_numpy() for c in ("family", "leaf", "block")], 1)
        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        out: list[list[np.ndarray]] = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low < 2:
                continue
            run = table.slice(low, high - low).combine_chunks()
            node, many, side = (run[c].to_numpy() for c in ("node", "vectors", "side"))
            units, _ = _units(run["vector"].combine_chunks() if isinstance(run["vector"], pa.ChunkedArray) else run["vector"])
            linked = units @ units.T >= min_cosine
            np.fill_diagonal(linked, False)
            # a block of two parts only compares across them
            linked &= (side[:, None] == 2) | (side[:, None] != side[None])
            if not linked.any():
                continue
            leaves = run["leaves"].combine_chunks() if isinstance(run["leaves"], pa.ChunkedArray) else run["leaves"]
            earlier = leaves.flatten().to_numpy()
            owner = np.repeat(np.arange(len(node)), np.diff(leaves.offsets.to_numpy()))
            before = earlier < keys[low, 1]
            names, column = np.unique(earlier[before], return_inverse=True)
            present = np.zeros((len(node), len(names)), np.float32)
            present[owner[before], column] = 1
            first = linked & ~(present @ present.T > 0)
            a, b = np.nonzero(np.triu(linked))
            nodes, lowest = smallest_reachable(node[a], node[b])
            place = np.searchsorted(nodes, node)
            place = np.minimum(place, len(nodes) - 1)
            has = nodes[place] == node
            out.append([node[has], (first @ many)[has], lowest[place][has]])
        if out:
            node, links, low = map(np.concatenate, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links.astype(np.int64)), pa.array(low, pa.int64())], names=["node", "links", "low"])


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    value = F.col("embedding")
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & value.isNotNull() & (F.size(value) > 0)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    sound = F.coalesce(sound & finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.xxhash64(F.col("label").cast("string"), value)).alias("node"), F.when(sound, F.xxhash64(F.lit(1), value)).alias("check"), F.xxhash64(F.col("label").cast("string"), F.size(value)).alias("family"), value.alias("vector"))
    groups = rows.where("node IS NOT NULL").groupBy("node", "check").agg(F.count("*").alias("vectors"), F.min("vec_id").alias("vec_id"), F.any_value("family").alias("family"), F.any_value("vector").alias("vector"))
    groups = scratch.keep(groups.withColumn("width", F.size("vector")), "groups")
    model = vectors.sparkSession.sparkContext.broadcast(fit_forest(groups, min_cosine))

    routed = groups.select("node", "vectors", "family", "width", "vector")
    routed = scratch.keep(routed.mapInArrow(lambda it: _route(model, it), T.StructType(routed.schema.fields + T.StructType.fromDDL("leaves array<bigint>, leaf bigint").fields)), "routed")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")
    leaves = routed.groupBy("family", "leaf").agg(F.count("*").alias("rows")).where("rows > 1").select("family", "leaf", blocks)
    dealt = routed.join(leaves, ["family", "leaf"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("family", "leaf", block.alias("block"), side.alias("side"), "node", "vectors", "vector", "leaves")
    dealt = dealt.repartition("family", "leaf", "block").sortWithinPartitions("family", "leaf", "block")
    found = scratch.keep(dealt.mapInArrow(lambda it: _compare(min_cosine, it), "node long, links long, low long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    united = components(scratch, found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    ids = groups.select("node", "check", "vec_id", "vectors").join(united, "node", "left").join(links, "node", "left")
    ids = scratch.keep(ids.withColumn("component", F.coalesce("component", "node")), "ids")
    lowest = ids.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    ids = ids.join(lowest, "component").select("node", "check", "component_id", (F.coalesce("links", F.lit(0)) + F.col("vectors") - 1).alias("n_links"))
    out = rows.select("vec_id", "node", "check").join(ids, ["node", "check"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
