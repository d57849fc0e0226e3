"""Exact nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates meet in tiles: each task holds a bounded block of queries and reads a stripe of candidates tile by tile.
A tile is one matrix product of int8 codes (whole numbers below 2^24, so a float32 product is exact). A vector is its scale times
its codes plus a remainder, so an inner product lies within |q'||c - c'| + |q - q'||c| of the scaled product. Pairs whose upper
bound falls below the bar of the query are left out; the bar is the larger of the k-th best score so far and the k-th largest
lower bound of the tile. Surviving pairs are computed again in double precision from the original vectors and merged into the
query's list of the best, and the lists of all stripes are merged by a heap.

Equal vectors take part once as queries, and at most ``k + 1`` times as candidates: equal scores go to the smaller ids, so the
k + 1 smallest ids of a vector are all that k places besides the query's own can show. Ranks are cut before the shuffle.

Defined results: rows without an id, and vectors that are null, empty, zero, or hold null or non-finite components take no
part. Vectors of different lengths don't meet. Rows that repeat an id are candidates each, but none of a query with that id;
rows that repeat id and vector are one query. An empty table, or a query without candidates, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm.jaccard import whole_runs
from frameops.llm.tables import Scratch

NEAREST = 20
#: Components of the queries of a block, candidates of a tile, pairs computed again at a time.
QUERY_CELLS, TILE_ROWS, PAIRS = 2_000_000, 256, 100_000
#: A table of n candidates is read in sqrt(n / STRIPE_SHARE) stripes, so that stripes and the lists they return both stay few.
STRIPE_SHARE = 1024
MOST_TASKS = 100_000
#: Room for rounding in the float32 scaling and the double sums, as a share of the product of the norms.
ROUNDING = 1e-5
_EXACT_CODES = 1024


class Codes:
    """Vectors as float32 whole numbers in -127..127, a scale each, and what the bounds need."""

    def __init__(self, values: np.ndarray) -> None:
        scale = np.abs(values).max(1) / 127
        self.codes = np.rint(values / scale[:, None])
        near = self.codes * scale[:, None]
        self.scale, self.norm = scale, np.linalg.norm(values, axis=1)
        self.near, self.rest = np.linalg.norm(near, axis=1), np.linalg.norm(values - near, axis=1)
        # sums of products of codes stay whole in float32 up to this many components
        self.codes = self.codes.astype(np.float32 if values.shape[1] <= _EXACT_CODES else np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Best:
    """The ``k`` best candidates of each query of a block: higher score first, then the smaller id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.values, self.k, self.query = queries, k, Codes(queries)
        self.row = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.bar = np.full(len(queries), -np.inf)

    def survivors(self, tile: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) of a tile whose upper bound reaches the bar."""
        q = self.query
        score = (q.codes @ tile.codes.T) * tile.scale[None].astype(q.codes.dtype) * q.scale[:, None].astype(q.codes.dtype)
        room = q.near[:, None] * tile.rest[None] + q.rest[:, None] * tile.norm[None] + ROUNDING * q.norm[:, None] * tile.norm[None]
        bar, n = self.bar, len(tile.scale)
        if n > self.k and not np.isfinite(bar).all():
            lower = np.partition(score - room, n - self.k, axis=1)[:, n - self.k]
            bar = np.maximum(bar, np.nan_to_num(lower, nan=-np.inf, posinf=-np.inf))
        # a bound that overflows to NaN keeps its pair
        return np.nonzero(~(score + room < bar[:, None]))

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        row, column = self.survivors(Codes(values))
        for low in range(0, len(row), PAIRS):
            r, c = row[low : low + PAIRS], column[low : low + PAIRS]
            score = _inner(self.values[r], values[c])
            alive = score >= self.bar[r]
            r, score, found = (np.concatenate(x) for x in ((self.row, r[alive]), (self.score, score[alive]), (self.id, ids[c[alive]])))
            order = np.lexsort((found, -score, r))
            r, score, found = r[order], score[order], found[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            kept = place < self.k
            self.row, self.score, self.id = r[kept], score[kept], found[kept]
            last = place == self.k - 1
            self.bar[r[last]] = score[last]


def _tiles(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the best of each query in a stripe. Rows come sorted: a task's queries stand before its candidates."""
    best, at, names, queries = None, None, None, []
    waiting: list[pa.Table] = []

    def read() -> None:
        nonlocal best, names, queries
        if best is None and queries:
            held = pa.concat_tables(queries).combine_chunks()
            best, names, queries = Best(_matrix(held["vector"].combine_chunks()), k), held["id"].to_numpy(), []
        if best is not None and waiting:
            held = pa.concat_tables(waiting).combine_chunks()
            for low in range(0, held.num_rows, TILE_ROWS):
                tile = held.slice(low, TILE_ROWS)
                best.add(tile["id"].to_numpy(), _matrix(tile["vector"].combine_chunks()))
        waiting.clear()

    def finish() -> Iterator[pa.RecordBatch]:
        read()
        if best is not None and len(best.row):
            first = np.searchsorted(best.row, np.arange(len(names) + 1))
            has = np.flatnonzero(np.diff(first))
            offsets = pa.array(np.append(first[has], len(best.row)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (best.id, best.score)]
            yield pa.RecordBatch.from_arrays([pa.array(names[has]), *lists], names=["query", "ids", "scores"])

    for table in whole_runs(batches, ["width", "block", "stripe", "side", "tile"]):
        keys = np.stack([table[c].to_numpy() for c in ("width", "block", "stripe", "side", "tile")], 1)
        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
        for low, high in zip(bounds[:-1], bounds[1:]):
            if at != tuple(keys[low, :3]):
                yield from finish()
                best, at, queries = None, tuple(keys[low, :3]), []
            if keys[low, 3] == 0:
                queries.append(table.slice(low, high - low))
            else:
                waiting.append(table.slice(low, high - low))
                if sum(t.num_rows for t in waiting) >= TILE_ROWS:
                    read()
    yield from finish()


def _merge(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of all lists of a query, by a heap over the heads of its sorted lists."""
    for table in whole_runs(batches, ["query"]):
        query = table["query"].to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1, [len(query)]])
        ids, scores = table["ids"].to_pylist(), table["scores"].to_pylist()
        found = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            lists = [[(-s, i) for s, i in zip(scores[j], ids[j])] for j in range(low, high)]
            best = heapq.merge(*lists)
            found += [(query[low], i, -s) for _, (s, i) in zip(range(k), best)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], names=["query", "id", "score"])


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str, salt: int) -> DataFrame:
    """Rows with a part of their own, copied to every part of the other side; ``sizes`` holds both counts by width."""
    out = rows.join(F.broadcast(sizes), "width").withColumn("own", F.pmod(F.xxhash64("id", "h1", F.lit(salt)), F.col(own)).cast("int"))
    return out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """For the rows of ``vectors`` (vec_id, embedding) that ``is_query`` marks: query_id, rank, vec_id, score."""
    scratch = Scratch(vectors.sparkSession, "nearest")
    value = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & (F.size(value) > 0) & F.exists(value, lambda x: x != 0)
    sound &= F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"), value.alias("vector"), F.size(value).alias("width"),
        F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    smallest = Window.partitionBy("width", "h1", "h2").orderBy("id")
    candidates = rows.drop("asks").withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).drop("place")
    candidates = scratch.keep(candidates, "candidates")
    asking = scratch.keep(rows.where("asks").select("id", "width", "h1", "h2").distinct(), "asking")
    same = ["width", "h1", "h2"]
    queries = rows.where("asks").groupBy(*same).agg(F.min("id").alias("id"), F.any_value("vector").alias("vector"))
    # written before use, so that the numbers stay what they are
    queries = scratch.keep(queries.withColumn("query", F.monotonically_increasing_id()), "queries")

    # one row per vector length
    blocks = queries.groupBy("width").agg(F.ceil(F.count("*") * F.col("width") / QUERY_CELLS).cast("int").alias("blocks"))
    stripes = candidates.groupBy("width").agg(F.ceil(F.sqrt(F.count("*") / STRIPE_SHARE)).cast("int").alias("stripes"))
    sizes = scratch.keep(blocks.join(stripes, "width"), "sizes")
    tasks = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("stripes"))).first()[0] or 1
    asked = _dealt(queries, sizes, "blocks", "stripes", 3).select(
        "width", F.col("own").alias("block"), F.col("other").alias("stripe"), F.lit(0).alias("side"), F.lit(0).alias("tile"), F.col("query").alias("id"), "vector")
    tile = F.pmod(F.xxhash64("h2", "id"), F.lit(64)).cast("int")
    offered = _dealt(candidates, sizes, "stripes", "blocks", 4).select(
        "width", F.col("other").alias("block"), F.col("own").alias("stripe"), F.lit(1).alias("side"), tile.alias("tile"), "id", "vector")
    met = asked.union(offered).repartition(min(tasks, MOST_TASKS), "width", "block", "stripe")
    met = met.sortWithinPartitions("width", "block", "stripe", "side", "tile")
    lists = scratch.keep(met.mapInArrow(lambda it: _tiles(k + 1, it), "query long, ids array<bigint>, scores array<double>"), "lists")
    merged = lists.repartition("query").sortWithinPartitions("query").mapInArrow(lambda it: _merge(k + 1, it), "query long, id long, score double")

    owners = asking.join(queries.select("query", *same), same).select(F.col("id").alias("query_id"), "query")
    found = owners.join(merged, "query").where("id <> query_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
