"""Suppression, clustering, fusion, fallback and sweeps over candidate boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.geometry import CORNERS, area, clamp_box, has_area, intersection, postfilter_drop, side_x, side_y
from frameops.lineage import cut, stored
from frameops.operators.greedy import IMAGE_LIMIT, clustered, grid_pairs, suppress
from frameops.operators.matching import average_precision, f_score, match_greedy, ratio, with_rates
from frameops.operators.rounds import linked_images
from frameops.operators.scale import hot_keys, running_totals, split_hot, top_k
from frameops.operators.sweeps import grid_scores, passing, per_point, signed_rows, trigger_scores


def by_score() -> list[Column]:
    """Visiting order of every greedy pass: score first, then the explicit id."""
    return [-F.col("score"), F.col("pred_id")]


def nms(boxes: DataFrame, threshold: float = 0.5, extra: Sequence[str] = (), limit: int = IMAGE_LIMIT) -> DataFrame:
    """Keep the best box, drop those overlapping it, repeat."""
    seeded = suppress(boxes, threshold, by_score(), "pred_id", extra, limit=limit)
    return seeded.filter(F.col("seed") == F.col("pred_id")).drop("seed")


def union_scored(groups: Sequence[DataFrame], threshold: float = 0.5) -> DataFrame:
    """Union of scored box sets, then B10."""
    return nms(reduce(DataFrame.unionByName, groups), threshold)


def cluster_boxes(boxes: DataFrame, threshold: float = 0.45, extra: Sequence[str] = (),
                  limit: int = IMAGE_LIMIT) -> DataFrame:
    """Clusters around high-score seeds with score-weighted mean corners.

    Corners are rounded half to even; the inner rounding to nine places removes
    summation noise around exact halves.
    """
    sums = clustered(boxes, threshold, by_score(), "pred_id", 1e-6, extra, limit)
    means = [F.bround(F.round(F.col(f"s_{c}") / F.col("s_w"), 9), 0).cast("bigint").alias(c) for c in CORNERS]
    merged = sums.select("image_id", *extra, "cluster_id", *means, "score", "members", "source_scores")
    return merged.withColumn("sources", F.map_keys("source_scores"))


def fuse(boxes: DataFrame, threshold: float = 0.5, min_score: float = 0.25, bonus: float = 0.05,
         penalty: float = 0.9) -> DataFrame:
    """Clusters scored by agreement between sources."""
    n = F.size("sources")
    raised = F.col("score") + F.lit(bonus) * (n - 1)
    score = F.least(F.lit(1.0), F.when(n == 1, raised * F.lit(penalty)).otherwise(raised))
    out = cluster_boxes(boxes, threshold).withColumn("score", score).withColumn("source_count", n)
    return out.filter(F.col("score") >= min_score)


def keep_default(clusters: DataFrame) -> DataFrame:
    """Without a model, single-source clusters are discounted and low scores dropped."""
    # fixed values: discount 0.88, floor 0.25
    score = F.when(F.size("sources") == 1, F.col("score") * 0.88).otherwise(F.col("score"))
    out = clusters.withColumn("score", score).filter(F.col("score") >= 0.25)
    return out.withColumn("score", F.least(F.lit(1.0), F.col("score")))


def fallback_merge(primary: DataFrame, fallback: DataFrame, triggered: DataFrame, threshold: float = 0.5,
                   scale: float = 0.95, limit: int = IMAGE_LIMIT) -> DataFrame:
    """On triggered images add fallback boxes, in id order, that overlap nothing merged so far."""
    columns = ["image_id", "pred_id", *CORNERS, "score"]
    first = primary.select(*columns, F.lit(0).alias("stage"))
    second = fallback.join(triggered.select("image_id").distinct(), "image_id", "left_semi").select(
        *columns, F.lit(1).alias("stage"))
    seeded = suppress(first.unionByName(second), threshold, [F.col("stage"), F.col("pred_id")], "pred_id",
                      fixed=F.col("stage") == 0, limit=limit)
    kept = seeded.filter(F.col("seed") == F.col("pred_id"))
    added = F.col("stage") == 1
    return kept.select("image_id", "pred_id", *CORNERS,
                       F.when(added, F.col("score") * scale).otherwise(F.col("score")).alias("score"),
                       added.alias("from_fallback"))


def images_with_few(primary: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Images with at most ``k`` primary boxes."""
    counts = primary.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    joined = images.select("image_id").distinct().join(counts, "image_id", "left")
    return joined.filter(F.coalesce("n", F.lit(0)) <= k).select("image_id")


def fallback_by_count(primary: DataFrame, fallback: DataFrame, k: int, threshold: float = 0.5,
                      scale: float = 0.95) -> DataFrame:
    """Fallback on images with at most ``k`` primary boxes."""
    images = primary.select("image_id").union(fallback.select("image_id"))
    return fallback_merge(primary, fallback, images_with_few(primary, images, k), threshold, scale)


def trigger_signals(primary: DataFrame, frames: DataFrame, size_px: float = 80.0, center_y: float = 0.62,
                    text: float = 30.0) -> DataFrame:
    """Per-image fallback signals from the primary boxes and the frame's text score.

    ``frames`` has image_id, height and text_score.
    """
    box_area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    per_image = primary.groupBy("image_id").agg(
        F.min(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).cast("double").alias("min_face"),
        F.max(F.struct(box_area.alias("a"), (-F.col("pred_id")).alias("o"),
                       ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"))).alias("top"))
    out = frames.select("image_id", "height", "text_score").join(per_image, "image_id", "left").select(
        "image_id", F.coalesce("min_face", F.lit(0.0)).alias("min_detected_face_size_px"),
        F.coalesce(F.col("top.cy") / F.greatest(F.col("height"), F.lit(1)), F.lit(0.0)).alias("dominant_center_y_ratio"),
        "text_score")
    size = F.col("min_detected_face_size_px")
    out = out.withColumns({
        "small_face_like": (size > 0) & (size <= size_px),
        "downward_like": F.col("dominant_center_y_ratio") >= center_y,
        "text_like": F.col("text_score") >= text})
    return out.withColumn("fallback_triggered", F.col("small_face_like") | F.col("downward_like") | F.col("text_like"))


def fallback_by_signal(primary, fallback, frames, threshold: float = 0.5, scale: float = 0.95, **limits) -> DataFrame:
    """Fallback on images whose signals trigger it."""
    signals = trigger_signals(primary, frames, **limits)
    return fallback_merge(primary, fallback, signals.filter("fallback_triggered"), threshold, scale)


def _truth_total(gt: DataFrame) -> DataFrame:
    return gt.agg(F.count(F.lit(1)).alias("ground_truth_boxes"))


def postfilter_points(margins: Sequence[int], sides: Sequence[int], scores: Sequence[float]) -> list[tuple]:
    return [(m, s, t) for m in margins for s in sides for t in scores]


#: The grid of edge margins, least sides and highest scores.
MARGINS, SIDES, TOP_SCORES = (0, 8, 16, 24, 32), (160, 200, 240, 280, 320, 360, 400), (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65)
#: The grid of fallback triggers.
SIZE_THRESHOLDS, CENTER_THRESHOLDS, TEXT_THRESHOLDS = (24.0, 32.0, 48.0, 64.0, 96.0, 128.0), (0.60, 0.62, 0.65, 0.68), (8.0, 12.0, 14.0, 18.0)


def dropped_at(pred: DataFrame, points: Sequence[tuple], width: int = 3840, height: int = 2160) -> DataFrame:
    """Boxes that some point of an edge/size/score grid drops, with the array ``grids`` of those points."""
    margins, sides, scores = zip(*points)
    droppable = pred.filter(postfilter_drop(max(margins), min(sides), max(scores), width, height))
    grids = passing(list(points), ["m", "s", "t"], lambda m, s, t: postfilter_drop(m, s, t, width, height))
    return droppable.withColumn("grids", grids).filter(F.size("grids") > 0)


def removed_per_point(pred: DataFrame, points: Sequence[tuple], width: int = 3840, height: int = 2160) -> DataFrame:
    """Rows and removed rows per grid point."""
    ids = pred.sparkSession.range(len(points)).withColumnRenamed("id", "grid_id")
    removed = per_point(dropped_at(pred, points, width, height), {"removed": F.lit(1)}, ids)
    return removed.crossJoin(F.broadcast(pred.agg(F.count(F.lit(1)).alias("rows"))))


def sweep_postfilter(pred: DataFrame, gt: DataFrame, margins: Sequence[int] = MARGINS, sides: Sequence[int] = SIDES,
                     scores: Sequence[float] = TOP_SCORES, width: int = 3840, height: int = 2160) -> DataFrame:
    """Scores for every point of an edge/size/score filter grid, with deltas to no filter.

    Boxes are matched once without a filter.  Only images that lose a box at
    some grid point are matched again, once per distinct set of lost boxes, and
    what that changes goes into the scores as signed rows.
    """
    spark = pred.sparkSession
    points = postfilter_points(margins, sides, scores)
    n = len(points)
    grid = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "grid_id bigint, edge_margin_px bigint, large_min_side_px bigint, max_score double")
    base = cut(match_greedy(pred, gt).select("image_id", "pred_id", "score", "true_positive"))
    droppable = cut(dropped_at(pred, points, width, height).select("image_id", "pred_id", "grids"))
    # the lost boxes of one image at one grid point, as an order-free fingerprint
    lost = droppable.select("image_id", "pred_id", F.explode("grids").alias("grid_id")).groupBy("image_id", "grid_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pred_id")).alias("h1"),
        F.bit_xor(F.xxhash64("pred_id", F.lit(1))).alias("h2"))
    lost = lost.withColumn("variant", F.concat_ws(":", "n", "h1", "h2"))
    changed = cut(lost.groupBy("image_id", "variant").agg(F.collect_list("grid_id").alias("grids")))
    dropped = changed.join(droppable.withColumnRenamed("grids", "at"), "image_id").filter(
        F.array_contains("at", F.col("grids")[0])).select("image_id", "variant", "pred_id")
    again = pred.join(changed.select("image_id", "variant"), "image_id").join(dropped, ["image_id", "variant", "pred_id"], "left_anti")
    variants = match_greedy(again, gt, extra=["variant"]).select("variant", "image_id", "pred_id", "score", "true_positive")
    # one more point than the grid has: no filter
    scored = cut(grid_scores(base, signed_rows(base, variants, changed), _truth_total(gt), n + 1))
    removed = per_point(droppable, {"removed_count": F.lit(1)}, grid)
    baseline = scored.filter(F.col("grid_id") == n).select(
        *[F.col(c).alias(f"base_{c}") for c in ("ap", "precision", "recall", "f1", "false_positives", "false_negatives")])
    out = grid.join(scored, "grid_id").join(removed, "grid_id").crossJoin(F.broadcast(baseline))
    deltas = {f"delta_{c}": F.col(c) - F.col(f"base_{c}")
              for c in ("ap", "precision", "recall", "f1", "false_positives", "false_negatives")}
    out = out.withColumns(deltas)
    viable = (F.col("delta_recall") >= -0.003) & (F.col("delta_false_positives") < 0)
    return out.withColumn("viable", viable).drop(*[c for c in out.columns if c.startswith("base_")])


def best_by(rows: DataFrame, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The row that is largest in ``order`` (end it with a unique column), per key.

    Doubles are compared at nine decimals, so that the order in which they were summed decides nothing.
    """
    kinds = [f.dataType.typeName() for f in rows.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema]
    order = [F.round(c, 9) if kind in ("double", "float") else c for c, kind in zip(order, kinds)]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return top.filter(F.col("r").isNotNull()).select("r.*")


def best_postfilter(rows: DataFrame) -> DataFrame:
    """Best viable point by AP, F1, fewer false positives; first point on ties."""
    return best_by(rows.filter("viable"), [F.col("ap"), F.col("f1"), -F.col("false_positives"), -F.col("grid_id")])


def sweep_fallback(primary: DataFrame, fallback: DataFrame, gt: DataFrame, frames: DataFrame,
                   sizes: Sequence[float] = SIZE_THRESHOLDS, centers: Sequence[float] = CENTER_THRESHOLDS,
                   texts: Sequence[float] = TEXT_THRESHOLDS, threshold: float = 0.5, scale: float = 0.95) -> DataFrame:
    """Scores per point of the trigger grid.

    A trigger only decides whether an image is merged, so the primary set and
    the merged set are each matched once and the grid picks between them.
    """
    spark = primary.sparkSession
    points = [(float(s), float(c), float(t)) for s in sizes for c in centers for t in texts]
    grid = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "grid_id bigint, size_threshold double, center_y_threshold double, text_threshold double")
    size = F.col("min_detected_face_size_px")
    signs = {
        "small_face_like": lambda s, c, t: (size > 0) & (size <= s),
        "downward_like": lambda s, c, t: F.col("dominant_center_y_ratio") >= c,
        "text_like": lambda s, c, t: F.col("text_score") >= t,
    }
    names = ["s", "c", "t"]
    signals = trigger_signals(primary, frames).withColumns({name: passing(points, names, sign) for name, sign in signs.items()})
    signals = stored(signals.select("image_id", *signs, F.array_sort(F.array_distinct(F.concat(*signs))).alias("grids")), "signals")
    scored = _trigger_scores(primary, fallback, gt, signals, frames, grid, len(points), threshold, scale)
    for name in signs:
        fired = signals.select(F.col(name).alias("grids"))
        scored = scored.join(per_point(fired, {f"{name}_images": F.lit(1)}, grid), "grid_id")
    return grid.join(scored, "grid_id")


def _trigger_scores(primary, fallback, gt, triggered, images, grid, n, threshold, scale) -> DataFrame:
    merged = stored(fallback_merge(primary, fallback, images.select("image_id"), threshold, scale).drop("from_fallback"), "merged")
    return trigger_scores(primary, merged, gt, triggered, images, grid, n)


def best_fallback(rows: DataFrame) -> DataFrame:
    """Best by F1, recall, fewer false positives, fewer triggers; first point on ties."""
    order = [F.round("f1", 6), F.round("recall", 6), -F.col("false_positives"), -F.col("triggered_images"), -F.col("grid_id")]
    return best_by(rows, order)


def fallback_by_label(primary: DataFrame, fallback: DataFrame, gt: DataFrame, condition: DataFrame,
                      labels: Sequence[str], threshold: float = 0.5, scale: float = 0.95) -> DataFrame:
    """Scores for every non-empty subset of trigger labels.  ``condition`` has image_id and condition_label.

    Subset g + 1 in binary says which labels point g holds.
    """
    spark, n = primary.sparkSession, 2 ** len(labels) - 1
    sets = [[label for bit, label in enumerate(labels) if (g + 1) >> bit & 1] for g in range(n)]
    grid = spark.createDataFrame([(g, "|".join(sorted(s))) for g, s in enumerate(sets)], "grid_id bigint, trigger_labels string")
    held = [(label, [g for g in range(n) if label in sets[g]]) for label in labels]
    grids = F.broadcast(spark.createDataFrame(held, "condition_label string, grids array<int>"))
    scored = _trigger_scores(primary, fallback, gt, condition.join(grids, "condition_label"), condition, grid, n, threshold, scale)
    return grid.join(scored, "grid_id").withColumn("grid_id", F.col("grid_id") + 1)


def best_label_policy(rows: DataFrame) -> DataFrame:
    """Best by recall, F1, fewer false positives, fewer triggers, each at six decimals; first subset on ties."""
    return best_by(rows, [F.round("recall", 6), F.round("f1", 6), -F.col("false_positives"), -F.col("triggered_images"), -F.col("grid_id")])


def recommended_label_policy(rows: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Among subsets within ``tolerance`` of the best recall, best by F1, precision, fewer false positives, fewer triggers."""
    rounded = rows.withColumns({c: F.round(c, 6) for c in ("recall", "f1", "precision")})
    order = [F.col("f1"), F.col("precision"), -F.col("false_positives"), -F.col("triggered_images"), -F.col("grid_id")]
    return recommend_within(rounded, tolerance, order)


def sweep_count_threshold(primary: DataFrame, fallback: DataFrame, gt: DataFrame, images: DataFrame,
                          ks: Sequence[int] = (0, 1, 2, 3, 4, 5), threshold: float = 0.5, scale: float = 0.95) -> DataFrame:
    """Scores for every count threshold of B15."""
    points = [(int(k),) for k in ks]
    grid = primary.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(points)], "grid_id bigint, count_threshold bigint")
    counts = images.select("image_id").distinct().join(
        primary.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left").fillna(0, ["n"])
    triggered = counts.withColumn("grids", passing(points, ["k"], lambda k: F.col("n") <= k))
    scored = _trigger_scores(primary, fallback, gt, triggered, images, grid, len(points), threshold, scale)
    return grid.join(scored, "grid_id").withColumn("grid_id", F.col("count_threshold")).drop("count_threshold")


def recommend_within(rows: DataFrame, tolerance: float, order: Sequence[Column]) -> DataFrame:
    """Among rows within ``tolerance`` of the best recall, the best by ``order``."""
    best = rows.agg(F.max("recall").alias("max_recall"))
    near = rows.crossJoin(F.broadcast(best)).filter(F.round("recall", 9) >= F.round(F.col("max_recall") - tolerance, 9))
    return best_by(near.drop("max_recall"), order)


def category_source(conditions: DataFrame, rules: Sequence[tuple[Sequence[str], str]], default: str) -> DataFrame:
    """Source per image from ordered (labels, source) rules; the first with a set label wins."""
    chosen = F
    for labels, source in rules:
        hit = reduce(lambda a, b: a | b, [F.col(label) == 1 for label in labels])
        chosen = chosen.when(hit, F.lit(source))
    return conditions.select("image_id", chosen.otherwise(F.lit(default)).alias("source"))


def select_by_source(boxes: DataFrame, chosen: DataFrame) -> DataFrame:
    """The boxes of each image's chosen source."""
    return boxes.join(chosen, ["image_id", "source"], "left_semi")


def cluster_features(clusters: DataFrame, frames: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Geometry and agreement features of a cluster, plus presence and score per source."""
    return framed_features(clusters.join(frames.select("image_id", "width", "height"), "image_id"), sources)


def framed_features(joined: DataFrame, sources: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """B23 for clusters that carry the width and height of their frame; the columns of ``keep`` stay."""
    c = F.col
    w, h = F.greatest(c("width"), F.lit(1)).cast("double"), F.greatest(c("height"), F.lit(1)).cast("double")
    bw, bh = F.greatest(F.lit(0.0), (c("x2") - c("x1")) / w), F.greatest(F.lit(0.0), (c("y2") - c("y1")) / h)
    scores = [F.coalesce(F.try_element_at("source_scores", F.lit(s)), F.lit(0.0)) for s in sources]
    total = reduce(lambda a, b: a + b, scores)
    mean = total / len(sources)
    spread = reduce(lambda a, b: a + b, [(s - mean) * (s - mean) for s in scores]) / len(sources)
    top, low = F.greatest(*scores), F.least(*scores)
    positive = reduce(lambda a, b: a + b, [F.when(s > 0, 1).otherwise(0) for s in scores])
    edge = F.least(c("x1") / w, c("y1") / h, (c("width") - c("x2")) / w, (c("height") - c("y2")) / h)
    per_source = []
    for name, score in zip(sources, scores, strict=True):
        per_source += [F.array_contains("sources", name).cast("double").alias(f"has_{name}"), score.alias(f"score_{name}")]
    return joined.select(
        "image_id", "cluster_id", *CORNERS, "score", F.size("sources").cast("double").alias("source_count"),
        bw.alias("width_ratio"), bh.alias("height_ratio"), (bw * bh).alias("area_ratio"),
        (((c("x1") + c("x2")) / 2.0) / w).alias("center_x"), (((c("y1") + c("y2")) / 2.0) / h).alias("center_y"),
        edge.alias("edge_distance"), (bh / F.greatest(bw, F.lit(1e-9))).alias("aspect"), top.alias("source_max"),
        mean.alias("source_mean"), F.sqrt(spread).alias("source_std"), (top - low).alias("source_range"),
        positive.cast("double").alias("source_positive"), *per_source, *keep)


# Folds the cell links of one image into its connected sets of cells.
_COMPONENTS = """
    aggregate(links, cast(array() as array<array<bigint>>),
      (sets, e) -> concat(
        filter(sets, s -> not arrays_overlap(s, e)),
        array(array_distinct(concat(e, flatten(filter(sets, s -> arrays_overlap(s, e))))))))
"""


def link_components(boxes: DataFrame, frames: DataFrame, link_frac: float = 0.09, min_count: int = 5,
                    margin: float = 0.18, min_area: float = 0.006, max_area: float = 0.45, limit: int = IMAGE_LIMIT) -> DataFrame:
    """Screen hypotheses from transitively linked boxes.

    Two boxes link when their centres lie within ``link`` in both axes.  ``frames`` has one row per image.  Images of at most
    ``limit`` boxes meet in one shuffle and are walked in array rounds; larger ones become graphs of grid cells.
    """
    c = F.col
    types = {boxes.schema[k].dataType.typeName() for k in CORNERS}
    if types <= {"integer", "long"}:
        hot = hot_keys(boxes, ["image_id"], limit)
        cold, large = (boxes, None) if hot is None else split_hot(boxes, ["image_id"], hot)
        grouped = _linked_in_rounds(cold, frames, link_frac)
        if large is not None:
            grouped = grouped.unionByName(_linked_by_cells(large, frames, link_frac, min_count).select(*grouped.columns))
    else:
        grouped = _linked_by_cells(boxes, frames, link_frac, min_count)
    mx = ((c("hx") - c("lx")) * F.lit(margin)).cast("bigint")
    my = ((c("hy") - c("ly")) * F.lit(margin)).cast("bigint")
    out = grouped.filter(c("members") >= min_count).select(
        "image_id", "members", F.greatest(F.lit(0), c("lx") - mx).alias("x1"), F.greatest(F.lit(0), c("ly") - my).alias("y1"),
        F.least(c("width"), c("hx") + mx).alias("x2"), F.least(c("height"), c("hy") + my).alias("y2"),
        (c("width") * c("height")).alias("frame_area"))
    share = area() / c("frame_area")
    return out.filter((share >= min_area) & (share <= max_area)).drop("frame_area").withColumn("score", F.lit(0.35))


def _linked_in_rounds(boxes: DataFrame, frames: DataFrame, link_frac: float) -> DataFrame:
    """Frames and boxes meet in one shuffle on the image; a task walks its images in rounds (``rounds``)."""
    c = F.col
    corners = [c(k).cast("long").alias(k) for k in CORNERS]
    whole = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in ("image_id", *CORNERS)])
    left = frames.filter(c("image_id").isNotNull() & (c("width") > 0) & (c("height") > 0)).select(
        "image_id", F.lit(0).alias("side"), c("width").cast("long").alias("width"), c("height").cast("long").alias("height"))
    right = boxes.filter(whole).select("image_id", F.lit(1).alias("side"), *corners)
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.repartition("image_id").sortWithinPartitions("image_id", "side", c("x1") + c("x2"))
    number = T.LongType()
    schema = T.StructType([T.StructField("image_id", rows.schema["image_id"].dataType),
                           *[T.StructField(k, number) for k in ("width", "height", "members", "lx", "ly", "hx", "hy")]])
    return rows.mapInArrow(lambda it: linked_images(link_frac, it), schema)


def _linked_by_cells(boxes: DataFrame, frames: DataFrame, link_frac: float, min_count: int) -> DataFrame:
    """Boxes in one grid cell of the size of a link always link, so the graph is built on cells (at most a few hundred per image,
    however many boxes there are): side neighbours link by the extreme coordinates of the two cells, diagonal neighbours by their
    facing corner points.
    """
    c = F.col
    enough = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") >= min_count)
    rows = boxes.join(enough.select("image_id"), "image_id", "left_semi").join(
        frames.select("image_id", "width", "height"), "image_id")
    rows = rows.withColumns({
        "link": F.lit(link_frac) * F.greatest("width", "height"),
        "cx": (c("x1") + c("x2")) / 2.0, "cy": (c("y1") + c("y2")) / 2.0})
    rows = rows.withColumns({"gx": F.floor(c("cx") / c("link")), "gy": F.floor(c("cy") / c("link"))})
    rows = rows.withColumn("cell", c("gx") * 100000 + c("gy"))
    cells = rows.groupBy("image_id", "cell", "gx", "gy", "link").agg(
        F.min("cx").alias("lx"), F.max("cx").alias("hx"), F.min("cy").alias("ly"), F.max("cy").alias("hy"))
    left = cells.select("image_id", "link", c("cell").alias("a"), "gx", "gy", c("hx").alias("ahx"), c("hy").alias("ahy"))
    right = cells.select("image_id", c("cell").alias("b"), c("lx").alias("blx"), c("ly").alias("bly"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1))])
    side = left.select("*", F.inline(steps)).withColumn("b", (c("gx") + c("dx")) * 100000 + c("gy") + c("dy"))
    side = side.join(right, ["image_id", "b"]).filter(
        F.when(c("dx") == 1, c("blx") - c("ahx") <= c("link")).otherwise(c("bly") - c("ahy") <= c("link")))
    diagonal = _diagonal_links(rows)
    own = cells.select("image_id", c("cell").alias("a"), c("cell").alias("b"))
    edges = own.union(side.select("image_id", "a", "b")).union(diagonal)
    # bounded by the cells of one image, not by its boxes
    sets = edges.groupBy("image_id").agg(F.collect_set(F.array("a", "b")).alias("links"))
    sets = sets.select("image_id", F.explode(F.expr(_COMPONENTS)).alias("cells"))
    labels = sets.select("image_id", F.array_min("cells").alias("component"), F.explode("cells").alias("cell"))
    return rows.join(labels, ["image_id", "cell"]).groupBy("image_id", "width", "height", "component").agg(
        F.count(F.lit(1)).alias("members"), F.min("x1").alias("lx"), F.min("y1").alias("ly"),
        F.max("x2").alias("hx"), F.max("y2").alias("hy"))


def _diagonal_links(rows: DataFrame) -> DataFrame:
    """Linked diagonal cell pairs.  Only the staircase of points facing the other cell can decide."""
    c = F.col
    # per cell and centre column only the outermost centres matter, so a cell keeps at most
    # one row per half pixel of its width
    points = rows.groupBy("image_id", "cell", "gx", "gy", "link", "cx").agg(F.max("cy").alias("top"), F.min("cy").alias("bottom"))

    def staircase(sign: int, high: bool) -> DataFrame:
        # facing up-right (sign 1) or up-left (sign -1); the lower cell keeps maxima, the upper one minima
        x = c("cx") * sign
        order = [x.desc(), c("cy").desc()] if high else [x.asc(), c("cy").asc()]
        window = Window.partitionBy("image_id", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        best = F.max("cy").over(window) if high else F.min("cy").over(window)
        keep = c("best").isNull() | (c("cy") > c("best") if high else c("cy") < c("best"))
        outer = points.withColumn("cy", c("top") if high else c("bottom"))
        return outer.withColumn("best", best).filter(keep).drop("best")

    found = []
    for sign in (1, -1):
        low = staircase(sign, True).select("image_id", "link", c("cell").alias("a"), c("cx").alias("ax"), c("cy").alias("ay"),
                                           ((c("gx") + sign) * 100000 + c("gy") + 1).alias("b"))
        high = staircase(sign, False).select("image_id", c("cell").alias("b"), c("cx").alias("bx"), c("cy").alias("by"))
        near = ((c("bx") - c("ax")) * sign <= c("link")) & (c("by") - c("ay") <= c("link"))
        found.append(low.join(high, ["image_id", "b"]).filter(near).select("image_id", "a", "b").distinct())
    return found[0].union(found[1])


def screen_cascade(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Per image, the boxes of the first source that has any, with its name."""
    columns = ["image_id", *CORNERS, "score"]
    tagged = [df.select(*columns, F.lit(i).alias("priority"), F.lit(name).alias("screen_source"))
              for i, (name, df) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = rows.groupBy("image_id").agg(F.min("priority").alias("priority"))
    return rows.join(first, ["image_id", "priority"], "left_semi").drop("priority")


def dominant_box(boxes: DataFrame, frames: DataFrame, box_id: str = "gt_id") -> DataFrame:
    """Largest clamped box per image (first id on ties) and its side, the root of the area."""
    c = F.col
    joined = boxes.join(frames.select("image_id", "width", "height"), "image_id")
    left = F.greatest(F.lit(0), F.least(c("x1"), c("width")))
    top = F.greatest(F.lit(0), F.least(c("y1"), c("height")))
    clamped = joined.select("image_id", box_id, left.alias("x1"), top.alias("y1"),
                            F.greatest(left + 1, F.least(c("x2"), c("width"))).alias("x2"),
                            F.greatest(top + 1, F.least(c("y2"), c("height"))).alias("y2"))
    best = clamped.groupBy("image_id").agg(F.max_by(
        F.struct(box_id, *CORNERS), F.struct(area().alias("a"), (-c(box_id)).alias("o"))).alias("b"))
    out = best.select("image_id", "b.*")
    return out.withColumn("face_size_px", F.sqrt(F.greatest(F.lit(1), area()).cast("double")))


def presence_confusion(pred: DataFrame, gt: DataFrame, frames: DataFrame) -> DataFrame:
    """Image-level confusion for "any region present", with precision, recall and F1."""
    p = pred.select("image_id").distinct().withColumn("p", F.lit(1))
    g = gt.select("image_id").distinct().withColumn("g", F.lit(1))
    flags = frames.select("image_id").join(p, "image_id", "left").join(g, "image_id", "left").fillna(0, ["p", "g"])
    out = flags.agg(
        F.count(F.lit(1)).alias("image_count"),
        *[F.count_if((F.col("p") == a) & (F.col("g") == b)).alias(name)
          for name, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))])
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
                           "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def coverage_purity(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Mean share of truth area covered and of predicted area on truth.

    Our definition: the sum of pairwise intersections, at most the box's area.
    """
    left = pred.select("image_id", *[F.col(k).alias("l_" + k) for k in ("pred_id", *CORNERS)])
    right = gt.select("image_id", *[F.col(k).alias("r_" + k) for k in ("gt_id", *CORNERS)])
    pairs = grid_pairs(left, right, ["image_id"]).withColumn("inter", intersection("l_", "r_"))
    covered = pairs.groupBy("image_id", F.col("r_gt_id").alias("gt_id")).agg(F.sum("inter").alias("inter"))
    on_truth = pairs.groupBy("image_id", F.col("l_pred_id").alias("pred_id")).agg(F.sum("inter").alias("inter"))

    def mean_share(boxes: DataFrame, sums: DataFrame, box_id: str, name: str) -> DataFrame:
        joined = boxes.filter(has_area()).join(sums, ["image_id", box_id], "left")
        return joined.agg(F.avg(F.least(F.lit(1.0), F.coalesce("inter", F.lit(0)) / area())).alias(name))

    return mean_share(gt, covered, "gt_id", "mean_ground_truth_area_coverage").crossJoin(
        mean_share(pred, on_truth, "pred_id", "mean_prediction_purity"))


def text_filter_sweep(pred: DataFrame, gt: DataFrame, splits: DataFrame, variants: Sequence[tuple[str, float, float, int]],
                      threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 per (filter variant, split).

    ``variants`` are (name, min_area, max_aspect, max_n); ``splits`` has image_id and split.  Ranks of all variants are running
    counts of one pass over an image's boxes, and variants that keep the same boxes of an image share one match of them.
    """
    spark, n = pred.sparkSession, len(variants)
    names = spark.createDataFrame([(i, v[0]) for i, v in enumerate(variants)], "grid_id int, name string")
    w, h = side_x().cast("double"), side_y().cast("double")
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0))
    passes = {f"__n{i}": ((w * h >= float(v[1])) & (aspect <= float(v[2]))).cast("int") for i, v in enumerate(variants)}
    ranked = running_totals(pred, ["image_id"], [F.col("score").desc(), F.col("pred_id")], passes)
    kept = {i: (passes[f"__n{i}"] == 1) & (F.col(f"__n{i}") <= int(v[3])) for i, v in enumerate(variants)}
    kept_at = F.array_compact(F.array(*[F.when(kept[i], F.lit(i)) for i in range(n)]))
    boxes = cut(ranked.withColumn("kept_at", kept_at).filter(F.size("kept_at") > 0).drop(*passes))
    # the boxes a variant keeps of one image, as an order-free fingerprint
    marks = [F.struct(F.lit(i).alias("grid_id"), F.concat_ws(":", *[
        agg(F.when(F.array_contains("kept_at", i), value)) for agg, value in (
            (F.count, F.lit(1)), (F.bit_xor, F.xxhash64("pred_id")), (F.bit_xor, F.xxhash64("pred_id", F.lit(1))))]).alias("variant")) for i in range(n)]
    sets = boxes.groupBy("image_id").agg(F.array(*marks).alias("m")).select("image_id", F.inline("m")).filter("variant <> '0'")
    sets = cut(sets.groupBy("image_id", "variant").agg(F.sort_array(F.collect_list("grid_id")).alias("grids")))
    rows = boxes.join(sets, "image_id").filter(F.array_contains("kept_at", F.col("grids")[0])).drop("kept_at", "grids")
    matches = match_greedy(rows, gt, threshold, ["variant"]).groupBy("image_id", "variant").agg(
        F.count_if("true_positive").alias("true_positives"), F.count_if("false_positive").alias("false_positives"))
    hits = matches.join(sets, ["image_id", "variant"]).join(splits, "image_id").groupBy("grids", "split").agg(
        F.sum("true_positives").alias("true_positives"), F.sum("false_positives").alias("false_positives"))
    hits = hits.select("split", F.explode("grids").alias("grid_id"), "true_positives", "false_positives").groupBy("grid_id", "split").agg(
        F.sum("true_positives").alias("true_positives"), F.sum("false_positives").alias("false_positives"))
    truth = gt.join(splits, "image_id").groupBy("split").agg(F.count(F.lit(1)).alias("ground_truth_boxes"))
    base = F.broadcast(names).crossJoin(splits.select("split").distinct()).join(truth, "split", "left")
    out = base.join(hits, ["grid_id", "split"], "left").drop("grid_id").fillna(0)
    return with_rates(out)


def text_outside_screens(texts: DataFrame, screens: DataFrame, cell: int = 256) -> DataFrame:
    """Texts with no corner and no centre inside a screen of their image.

    The five test points each fall into one grid cell and meet only the screens
    that touch that cell.
    """
    c = F.col
    points = [("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")]
    tested = F.array(*[F.struct(c(x).cast("double").alias("px"), c(y).cast("double").alias("py")) for x, y in points],
                     F.struct(((c("x1") + c("x2")) / 2.0).alias("px"), ((c("y1") + c("y2")) / 2.0).alias("py")))
    spots = texts.select("image_id", "pred_id", F.inline(tested))
    spots = spots.withColumns({"gx": F.floor(c("px") / cell), "gy": F.floor(c("py") / cell)})
    span = lambda a, b: F.sequence(F.floor(c(a) / cell), F.floor(c(b) / cell))
    areas = screens.filter((c("x2") >= c("x1")) & (c("y2") >= c("y1"))).select("image_id", *CORNERS)
    areas = areas.withColumn("gx", F.explode(span("x1", "x2"))).withColumn("gy", F.explode(span("y1", "y2")))
    inside = c("px").between(c("x1"), c("x2")) & c("py").between(c("y1"), c("y2"))
    hit = spots.join(areas, ["image_id", "gx", "gy"]).filter(inside).select("image_id", "pred_id").distinct()
    return texts.join(hit, ["image_id", "pred_id"], "left_anti")


def filter_screens(boxes: DataFrame) -> DataFrame:
    """screens by area share and score, then B10 at 0.5.  Needs width and height columns."""
    # fixed values: area share 0.0008 to 0.55; score below 0.12 only up to a share of 0.02
    share = area() / (F.col("width") * F.col("height"))
    kept = boxes.filter(share.between(0.0008, 0.55) & ~((F.col("score") < 0.12) & (share > 0.02)))
    return nms(kept, 0.5)


def filter_texts(boxes: DataFrame) -> DataFrame:
    """texts by side and area share, B10 at 0.4, then the 40 best per image."""
    # fixed values: side 8; area share 0.00015 to 0.12; long side 0.55 with share 0.04; 40 boxes
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = area() / (F.col("width") * F.col("height"))
    long_and_large = (F.greatest(w, h) > 0.55 * F.greatest("width", "height")) & (share > 0.04)
    kept = boxes.filter((w >= 8) & (h >= 8) & share.between(0.00015, 0.12) & ~long_and_large)
    best = top_k(nms(kept, 0.4), ["image_id"], [F.col("score").desc(), F.col("pred_id")], 40)
    return best.drop("rank")


def keep_recognised_text(rows: DataFrame, min_score: float = 0.3) -> DataFrame:
    """recognised text regions worth keeping.  Needs text, score, corners, width and height."""
    # fixed values: 3 alphanumerics, 8 px wide, 6 px high, area share 0.08
    clean = F.regexp_replace("text", "[^A-Za-z0-9]", "")
    share = area() / F.greatest(F.lit(1), F.col("width") * F.col("height"))
    return rows.filter((F.length(clean) >= 3) & (F.col("score") >= min_score) & (F.col("x2") - F.col("x1") >= 8)
                       & (F.col("y2") - F.col("y1") >= 6) & (share <= 0.08))


def untile_boxes(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """boxes in tile coordinates moved to frame coordinates, then B10 per image."""
    moved = {c: F.col(c) + F.col("tile_x" if c[0] == "x" else "tile_y") for c in CORNERS}
    return nms(boxes.withColumns(moved), threshold)


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """F03 on a table with width and height: clamped corners, boxes without area dropped."""
    return boxes.withColumns(clamp_box(F.col("width"), F.col("height"))).filter(has_area())
