"""Embeddings, re-identification and text readability."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.labels import stable_order, text_similarity
from frameops.lineage import cut
from frameops.operators.scale import exact_quantiles

# Gallery rows of a block, queries of a cell that one task reads, least and most pivots.
BLOCK, QUERIES, PIVOTS = 2048, 200_000, (16, 2048)


def l2_normalise(vector: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    divisor = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    # bound once per vector; inside the inner lambda it would be computed per element
    return F.transform(F.array(divisor), lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def paired_cosine(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Cosine of matched original and output crops."""
    a = before.select(key, l2_normalise(F.col("embedding")).alias("a"))
    b = after.select(key, l2_normalise(F.col("embedding")).alias("b"))
    return a.join(b, key).select(key, dot(F.col("a"), F.col("b")).alias("cosine"))


def threshold_hits(cosines: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7)) -> DataFrame:
    """Share of cosines at or above each threshold."""
    return cosines.agg(F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("mean_cosine"),
                       *[F.avg((F.col("cosine") >= t).cast("double")).alias(f"rate_{int(t * 100):03d}") for t in thresholds])


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of a list column; a zero vector stays as it is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((values * values).sum(axis=1, keepdims=True))
    return values / np.where(norm == 0, 1.0, norm)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _with_home(pivots, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the cell of their nearest pivot and the angle to it."""
    for batch in batches:
        if batch.num_rows:
            angle = _angles(_units(batch["v"]), pivots.value)
            cell = angle.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "near"])


def _other_cells(pivots, radius, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per further cell that may hold a match nearer than the bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        open_cells = _angles(_units(batch["v"]), pivots.value) - radius.value[None] <= batch["bound"].to_numpy()[:, None]
        open_cells[np.arange(batch.num_rows), batch["cell"].to_numpy()] = False
        row, cell = np.nonzero(open_cells)
        for low in range(0, len(row), 5000):
            part = batch.select(["q_id", "v"]).take(pa.array(row[low : low + 5000]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[low : low + 5000].astype(np.int32))], names=["q_id", "v", "cell"])


def _best_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best gallery row of a block for each query that streams past it; a block's gallery rows come first, by id."""
    at, held, units = None, [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("cell", "g_part", "q_part", "side")], 1)
        for part in np.split(np.arange(len(keys)), np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1):
            if not len(part):
                continue
            key, rows = tuple(keys[part[0]]), batch.slice(part[0], len(part))
            if key[:3] != at:
                at, held, units = key[:3], [], None
            if key[3] == 0:
                held.append(rows)
                continue
            if not held:
                continue
            if units is None:
                gallery = pa.Table.from_batches(held).combine_chunks()
                units = _units(gallery["v"])
            scores = _units(rows["v"]) @ units.T
            # equal similarities up to rounding go to the lowest id
            top = (scores >= scores.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
            best = gallery.select(["g_id", "g_identity"]).take(pa.array(top)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([rows["q_id"], *best.columns, pa.array(scores[np.arange(len(top)), top])], names=["q_id", "g_id", "g_identity", "similarity"])


def _meet(wanted: DataFrame, gallery: DataFrame, block: int) -> DataFrame:
    """Best row per (query, block of a cell): each gallery row goes to one task, unless a cell has very many queries."""
    counts = gallery.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("g_parts")).join(
        wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("q_parts")), "cell")
    # a row per pivot at most
    counts = F.broadcast(cut(counts))

    def dealt(rows: DataFrame, own: str, other: str, key: str) -> DataFrame:
        placed = rows.join(counts, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    order = ["cell", "g_part", "q_part", "side", "g_id"]
    columns = [*order, "g_identity", "q_id", "v"]
    left = dealt(gallery, "g_part", "q_part", "g_id").withColumns({"side": F.lit(0), "q_id": F.lit(None).cast(wanted.schema["q_id"].dataType)})
    right = dealt(wanted, "q_part", "g_part", "q_id").withColumns({"side": F.lit(1), **{c: F.lit(None).cast(gallery.schema[c].dataType) for c in ("g_id", "g_identity")}})
    met = left.select(*columns).union(right.select(*columns)).repartition("cell", "g_part", "q_part").sortWithinPartitions(*order)
    schema = T.StructType([met.schema["q_id"], met.schema["g_id"], met.schema["g_identity"], T.StructField("similarity", T.DoubleType())])
    return met.mapInArrow(_best_in_block, schema)


def _first_best(parts: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.round("similarity", 12)).alias("s"), "g_id", "g_identity")).alias("b")
    return parts.groupBy("q_id").agg(best).select("q_id", "b.g_id", "b.g_identity", (-F.col("b.s")).alias("similarity"))


def nearest(query: DataFrame, gallery: DataFrame, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """Most similar gallery row per query (lowest id on ties), exactly.

    Pivots, as many as the root of the gallery's rows within ``PIVOTS``, cut the
    gallery into cells.  A query first meets the cell of its nearest pivot; what it finds there, or the gallery's row of
    its own identity, bounds the angle of the best match, and by the triangle inequality only cells that may hold a nearer
    row are searched after that.  Vectors travel as they are stored; a gallery row is shipped once per search, in blocks of
    at most ``block`` rows that queries stream past, each batch one matrix product.
    Returns id, best_id, best_identity, similarity.
    """
    spark = query.sparkSession
    q = query.select(F.col("id").alias("q_id"), "identity", F.col("embedding").alias("v")).filter("v IS NOT NULL")
    g = gallery.select(F.col("id").alias("g_id"), F.col("identity").alias("g_identity"), F.col("embedding").alias("v")).filter("v IS NOT NULL")
    wanted = pivots or min(PIVOTS[1], max(PIVOTS[0], math.isqrt(g.count())))
    seeds = g.orderBy(stable_order(42, F.col("g_id")), "g_id").limit(wanted).select("v").toArrow()
    if not seeds.num_rows:
        return query.select("id", "identity", F.lit(None).cast("bigint").alias("best_id"), F.lit(None).cast("bigint").alias("best_identity"), F.lit(0.0).alias("similarity"))
    centre = spark.sparkContext.broadcast(_units(seeds["v"]))

    def home(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda it: _with_home(centre, it), T.StructType([*rows.schema.fields, *T.StructType.fromDDL("cell int, near double").fields]))

    g = cut(home(g))
    reach = np.full(seeds.num_rows, -np.inf)
    for r in g.groupBy("cell").agg(F.max("near").alias("radius")).collect():
        reach[r["cell"]] = r["radius"]
    radius = spark.sparkContext.broadcast(reach)
    q = cut(home(q).drop("near"))
    first = cut(_first_best(_meet(q.select("q_id", "v", "cell"), g, block)))
    own = g.groupBy(F.col("g_identity").alias("identity")).agg(F.any_value("v").alias("gv"))
    own = q.join(own, "identity").select("q_id", dot(l2_normalise(F.col("v")), l2_normalise(F.col("gv"))).alias("own"))
    known = q.join(first.select("q_id", "similarity"), "q_id", "left").join(own, "q_id", "left")
    least = F.greatest(F.coalesce("similarity", F.lit(-1.0)), F.coalesce("own", F.lit(-1.0)), F.lit(-1.0))
    bounded = known.select("q_id", "v", "cell", (F.acos(F.least(F.lit(1.0), least)) + F.lit(1e-6)).alias("bound"))
    others = T.StructType([q.schema["q_id"], q.schema["v"], T.StructField("cell", T.IntegerType())])
    rest = cut(bounded.mapInArrow(lambda it: _other_cells(centre, radius, it), others))
    best = _first_best(first.unionByName(_first_best(_meet(rest, g, block))))
    return query.select("id", "identity").join(best.withColumnRenamed("q_id", "id"), "id", "left").select(
        "id", "identity", F.col("g_id").alias("best_id"), F.col("g_identity").alias("best_identity"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def reid_rank1(query: DataFrame, gallery: DataFrame) -> DataFrame:
    """E03 (with J17): best gallery match per query and whether it is the query's own identity."""
    hit = F.coalesce(F.col("best_identity") == F.col("identity"), F.lit(False))
    return nearest(query, gallery).withColumn("hit", hit)


def reid_rate(matches: DataFrame) -> DataFrame:
    """Rank-1 rate; 0 without queries."""
    return matches.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("rank1_rate"),
                       F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"))


def max_similarity(query: DataFrame, gallery: DataFrame) -> DataFrame:
    """Best gallery cosine per query; 0 without a gallery."""
    return nearest(query, gallery).select("id", "similarity")


def gaussian_moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (ddof 1) from per-partition sums; d x d numbers reach the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for batch in batches:
            if batch.empty:
                continue
            m = _matrix(batch["v"])
            total = m.sum(axis=0) if total is None else total + m.sum(axis=0)
            gram = m.T @ m if gram is None else gram + m.T @ m
            n += len(m)
        if n:
            yield pd.DataFrame({"sums": [np.concatenate([[float(n)], total, gram.ravel()])]})

    sums = vectors.select(F.col(column).alias("v")).mapInPandas(partial, "sums array<double>")
    rows = sums.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    flat = np.array([r["x"] for r in rows])
    if flat.size == 0 or flat[0] < 2:
        raise ValueError("at least two vectors are needed")
    n = flat[0]
    d = int(round((-1 + math.sqrt(1 + 4 * (flat.size - 1))) / 2))
    mean = flat[1:d + 1] / n
    return int(n), mean, (flat[d + 1:].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)


def frechet(a: DataFrame, b: DataFrame, column: str = "embedding") -> DataFrame:
    """Fréchet distance of two sets of vectors, never below 0."""
    n1, m1, s1 = gaussian_moments(a, column)
    n2, m2, s2 = gaussian_moments(b, column)
    values, basis = np.linalg.eigh(s1)
    root = basis @ np.diag(np.sqrt(np.clip(values, 0.0, None))) @ basis.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ s2 @ root), 0.0, None)).sum()
    distance = float(np.sum((m1 - m2) ** 2) + np.trace(s1) + np.trace(s2) - 2.0 * cross)
    return a.sparkSession.createDataFrame([(max(0.0, distance), n1, n2)], "frechet_distance double, n_reference bigint, n_comparison bigint")


def region_similarity(pairs: DataFrame, method: str = "ratio") -> DataFrame:
    """Similarity per text region before and after."""
    return pairs.withColumn("similarity", text_similarity(F.col("before"), F.col("after"), method))


def suppression_rate(regions: DataFrame, keys: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Share of regions whose similarity fell below the threshold."""
    return regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), F.avg((F.col("similarity") < threshold).cast("double")).alias("suppression_rate"))


def redaction_audit(regions: DataFrame, key: str, document: str, threshold: float = 0.5) -> DataFrame:
    """Similarity and suppression per ``key``, regions and documents that kept their text; blank regions count apart.

    Documents are counted over one row each, so that no distinct set of them gathers in a task.
    """
    c, blank = F.col, F.trim("before") == ""
    same = (c("similarity") >= 1.0) & ~blank
    per_document = regions.groupBy(key, document).agg(
        F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"), F.count_if(c("similarity") < threshold).alias("low"),
        F.count_if(same).alias("same"), F.count_if(blank).alias("blank"))
    return per_document.groupBy(key).agg(
        F.sum("n").alias("regions"), (F.sum("s") / F.sum("n")).alias("mean_similarity"), (F.sum("low") / F.sum("n")).alias("suppression_rate"),
        F.sum("same").alias("unchanged_regions"), F.sum("blank").alias("blank_regions"), F.count_if(c("same") > 0).alias("documents_with_residual"))


def readability_summary(regions: DataFrame) -> DataFrame:
    """Mean, median, minimum and maximum similarity; zeros without regions."""
    zero = F.lit(0.0)
    base = regions.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(fn("similarity"), zero).alias(k) for k, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    middle = exact_quantiles(regions.select("similarity"), [], "similarity", {"median": 0.5}).agg(F.coalesce(F.max("median"), zero).alias("median"))
    return base.crossJoin(middle)


def procrustes_error(points: DataFrame, key: str = "id") -> DataFrame:
    """Landmark shape distance after centring, scaling and orthogonal alignment.

    ``points``: key, ax, ay (original) and bx, by (output), one row per landmark.
    Closed form from grouped moments: sqrt(2 - 2 nuc(M) / n), nuc = sqrt(|M|^2 + 2 |det M|).
    """
    c = F.col
    sums = points.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in ("ax", "ay", "bx", "by")],
        *[F.avg(c(x) * c(y)).alias(f"p_{x}_{y}") for x, y in (("ax", "ax"), ("ay", "ay"), ("bx", "bx"), ("by", "by"), ("ax", "bx"), ("ax", "by"), ("ay", "bx"), ("ay", "by"))])
    cov = lambda x, y: c(f"p_{x}_{y}") - c(f"m_{x}") * c(f"m_{y}")
    scale_a = F.greatest(F.sqrt(F.greatest(F.lit(0.0), cov("ax", "ax") + cov("ay", "ay"))), F.lit(1e-8))
    scale_b = F.greatest(F.sqrt(F.greatest(F.lit(0.0), cov("bx", "bx") + cov("by", "by"))), F.lit(1e-8))
    out = sums.withColumns({k: cov(x, y) / (scale_a * scale_b) for k, x, y in (("m11", "ax", "bx"), ("m12", "ax", "by"), ("m21", "ay", "bx"), ("m22", "ay", "by"))})
    out = out.withColumns({"flat_a": (cov("ax", "ax") + cov("ay", "ay")) / (scale_a * scale_a), "flat_b": (cov("bx", "bx") + cov("by", "by")) / (scale_b * scale_b)})
    frobenius = c("m11") * c("m11") + c("m12") * c("m12") + c("m21") * c("m21") + c("m22") * c("m22")
    determinant = F.abs(c("m11") * c("m22") - c("m12") * c("m21"))
    nuclear = F.sqrt(F.greatest(F.lit(0.0), frobenius + 2 * determinant))
    return out.select(key, F.sqrt(F.greatest(F.lit(0.0), c("flat_a") + c("flat_b") - 2 * nuclear)).alias("procrustes_error"))
