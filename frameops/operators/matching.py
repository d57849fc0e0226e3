"""Matching detections to ground truth and scoring them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.geometry import CORNERS, iou
from frameops.lineage import shuffles_removed, stored
from frameops.operators.crowded import overlap_counts
from frameops.operators.greedy import IMAGE_LIMIT, assign
from frameops.operators.scale import GROUP_LIMIT, running_totals
from frameops.operators.subsets import MOST_SUBSETS, subset_bits, subset_precision


#: Keys of a precision table that are told apart by number.
MOST_MODELS = 1_000


def match_greedy(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, extra: Sequence[str] = (),
                 limit: int = IMAGE_LIMIT, keep: Sequence[str] | None = None, notes: DataFrame | None = None) -> DataFrame:
    """Per image, predictions by score take the free truth box of highest IoU.

    With ``keep``, only these columns of the predictions travel on; for ``notes`` see ``assign``.
    """
    order = [-F.col("score"), F.col("pred_id")]
    if keep is not None:
        pred = pred.select(*dict.fromkeys(["image_id", "pred_id", "score", *CORNERS, *extra, *keep]))
    matched = assign(pred, gt, threshold, order, "pred_id", "gt_id", extra, limit, keep, notes)
    return matched.select(
        "*",
        F.col("target").alias("gt_id"),
        F.col("best_iou").alias("iou"),
        F.col("target").isNotNull().alias("true_positive"),
        F.col("target").isNull().alias("false_positive"),
    ).drop("target", "best_iou")


def match_gt_order(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, limit: int = IMAGE_LIMIT) -> DataFrame:
    """Truth boxes, in id order, take the free prediction of highest IoU."""
    truth = gt.select("image_id", "gt_id", *CORNERS)
    matched = assign(truth, pred, threshold, [F.col("gt_id")], "gt_id", "pred_id", (), limit, ["image_id", "gt_id"])
    return matched.select(
        "image_id", "gt_id", F.col("target").alias("pred_id"), F.col("best_iou").alias("iou"),
        F.col("target").isNotNull().alias("matched"),
    )


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when the bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    weight = beta * beta
    bottom = F.lit(weight) * precision + recall
    return F.when(bottom > 0, F.lit(1 + weight) * precision * recall / bottom).otherwise(F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to true_positives, false_positives and ground_truth_boxes."""
    tp, fp, n = F.col("true_positives"), F.col("false_positives"), F.col("ground_truth_boxes")
    some = n > 0
    out = counts.withColumns({
        "precision": F.when(some, ratio(tp, tp + fp)).otherwise(F.lit(0.0)),
        "recall": F.when(some, tp / n).otherwise(F.lit(0.0)),
        "false_negatives": F.when(some, F.greatest(F.lit(0), n - tp)).otherwise(F.lit(0)),
    })
    return out.withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def average_precision(matches: DataFrame, truth_counts: DataFrame, keys: Sequence[str] = (),
                      limit: int = GROUP_LIMIT, at_most: int | None = None) -> DataFrame:
    """B03 (with the running sums of W06): AP, precision, recall, F1 and counts per key.

    ``truth_counts`` holds the keys and ``ground_truth_boxes``.  Recall moves only
    at a true positive, so AP is the sum of precision at true positives over the
    number of truth boxes.
    """
    keys = list(keys)
    if len(keys) < 2 and dict(matches.dtypes)["score"] == "double":
        names = [r[0] for r in truth_counts.select(*keys).distinct().take(MOST_MODELS + 1)] if keys else [0]
        if 0 < len(names) <= MOST_MODELS:
            return _ranked_precision(matches, truth_counts, keys, names)
    hit = F.col("true_positive").cast("bigint")
    order = [F.col("score").desc(), F.col("image_id"), F.col("pred_id")]
    placed = running_totals(matches.select(*keys, "score", "image_id", "pred_id", "true_positive"),
                            keys, order, {"hits": hit, "seen": F.lit(1)}, limit, at_most)
    summed = placed.groupBy(*keys).agg(
        F.sum(F.when(F.col("true_positive"), F.col("hits") / F.col("seen"))).alias("precision_sum"),
        F.sum(hit).alias("true_positives"),
        F.sum(1 - hit).alias("false_positives"),
    )
    joined = truth_counts.join(summed, keys, "left") if keys else truth_counts.crossJoin(summed)
    return average_precision_columns(joined.fillna(0, ["precision_sum", "true_positives", "false_positives"]), keys)


def _ranked_precision(matches: DataFrame, truth_counts: DataFrame, keys: list[str], names: list) -> DataFrame:
    """B03 for few keys, whose rows are walked in ranges of their rank (``subsets``)."""
    model = keys[0] if keys else "__model"
    rows = matches.select(*keys, "image_id", "pred_id", "score", "true_positive", F.lit(1).cast("long").alias("mask"))
    counts, _ = subset_precision(rows if keys else rows.withColumn(model, F.lit(0)), names, ["all"], model)
    counts = counts.drop("subgroup") if keys else counts.drop("subgroup", model)
    if keys:
        joined = truth_counts.join(F.broadcast(counts), keys, "left")
    else:
        joined = truth_counts.join(F.broadcast(counts), F.lit(True), "left")
    return average_precision_columns(joined.fillna(0, ["precision_sum", "true_positives", "false_positives"]), keys)


def average_precision_columns(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result columns of B03 from precision_sum, true_positives, false_positives and ground_truth_boxes."""
    return with_rates(counts).select(
        *keys, ratio(F.col("precision_sum"), F.col("ground_truth_boxes")).alias("ap"), "precision", "recall", "f1",
        F.when(F.col("ground_truth_boxes") > 0, F.col("true_positives")).otherwise(F.lit(0)).alias("true_positives"),
        F.when(F.col("ground_truth_boxes") > 0, F.col("false_positives"))
        .otherwise(F.col("true_positives") + F.col("false_positives")).alias("false_positives"),
        "false_negatives", "ground_truth_boxes",
    )


def detector_score(recall: Column, f1: Column, precision: Column) -> Column:
    """Composite of the face detection stage."""
    # fixed values: weights of recall, f1, precision
    return 0.65 * recall + 0.25 * f1 + 0.10 * precision


def score_subgroups(pred: DataFrame, gt: DataFrame, membership: DataFrame, model: str = "model",
                    threshold: float = 0.5, limit: int = IMAGE_LIMIT) -> DataFrame:
    """Scores per (model, subgroup).  Boxes are matched once; subgroups reuse the matches.

    ``membership`` is a set of (image_id, subgroup).  ``pred`` carries the model column.
    A match carries the subgroups of its image as bits, so it is ranked once for all of them.
    """
    in_group = membership.select("image_id", "subgroup")
    with shuffles_removed(pred.sparkSession):
        names = sorted((r["subgroup"] for r in in_group.select("subgroup").distinct().take(MOST_SUBSETS + 1)), key=lambda x: (x is not None, x))
    kinds = dict(pred.dtypes)
    plain = kinds["image_id"] in ("int", "bigint") and kinds["score"] == "double" and None not in names
    if plain and 0 < len(names) <= MOST_SUBSETS:
        base, scored = _score_by_bits(pred, gt, in_group, names, model, threshold, limit)
    else:
        matches = match_greedy(pred, gt, threshold, [model], limit)
        images = in_group.groupBy("subgroup").agg(F.count_distinct("image_id").alias("image_count"))
        base, scored = _score_by_rows(matches, pred, gt, in_group, images, model)
    scored = scored.join(F.broadcast(base.select(model, "subgroup", "image_count", "images_with_boxes")), [model, "subgroup"])
    empty = F.col("ground_truth_boxes") == 0
    scored = scored.withColumns({
        "prediction_boxes": F.col("true_positives") + F.col("false_positives"),
        "zero_face_false_positive_images": F.when(empty, F.col("images_with_boxes")).otherwise(F.lit(0)),
        "zero_face_specificity": F.when(
            empty, 1 - F.col("images_with_boxes") / F.greatest(F.lit(1), F.col("image_count"))),
    })
    composite = detector_score(F.col("recall"), F.col("f1"), F.col("precision"))
    return scored.withColumn(
        "composite", F.when(empty, F.col("zero_face_specificity")).otherwise(composite)
    ).drop("images_with_boxes")


def _score_by_bits(pred: DataFrame, gt: DataFrame, in_group: DataFrame, names: Sequence[str], model: str, threshold: float,
                   limit: int) -> tuple[DataFrame, DataFrame]:
    """Counts and AP rows of B04 when subgroups fit the bits of a number, which meets the boxes in the shuffle of their match."""
    spark, c = pred.sparkSession, F.col
    models = sorted((r[0] for r in pred.select(model).distinct().collect()), key=lambda x: (x is not None, x))
    masks = stored(in_group.filter(c("image_id").isNotNull()).groupBy("image_id").agg(F.bit_or(subset_bits(names)).alias("mask")), "masks")
    per_image = masks.join(gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left")
    per_mask = per_image.groupBy("mask").agg(F.count(F.lit(1)).alias("image_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("ground_truth_boxes"))
    subgroup = F.explode(F.array_compact(F.array(*[F.when(c("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]))).alias("subgroup")
    totals = stored(per_mask.select(subgroup, "image_count", "ground_truth_boxes").groupBy("subgroup").agg(
        F.sum("image_count").alias("image_count"), F.sum("ground_truth_boxes").alias("ground_truth_boxes")), "totals")
    matches = match_greedy(pred, gt, threshold, [model], limit, ["image_id", "pred_id", "score", model], masks.withColumnRenamed("mask", "note"))
    counts, ranked = subset_precision(matches.withColumnRenamed("note", "mask"), models, names, model)
    # only subgroups without truth need the number of images with boxes
    quiet = [r["subgroup"] for r in totals.filter("ground_truth_boxes = 0").collect()]
    wanted = sum(1 << i for i, name in enumerate(names) if name in quiet)
    flagged = ranked.filter(c("mask").bitwiseAND(F.lit(wanted).cast("long")) != 0).select("image_id", "m", "mask").distinct()
    flagged = flagged.groupBy("m", "mask").agg(F.count(F.lit(1)).alias("n")).select("m", subgroup, "n")
    flagged = stored(flagged.groupBy("m", "subgroup").agg(F.sum("n").alias("images_with_boxes")).filter(c("subgroup").isin(*quiet)), "flagged")
    table = spark.createDataFrame(list(enumerate(models)), f"m int, `{model}` {dict(pred.dtypes)[model]}")
    base = table.crossJoin(F.broadcast(totals)).join(F.broadcast(flagged), ["m", "subgroup"], "left").fillna(0, ["images_with_boxes"]).drop("m")
    joined = base.select(model, "subgroup", "ground_truth_boxes").join(F.broadcast(counts), [model, "subgroup"], "left")
    return base, average_precision_columns(joined.fillna(0, ["precision_sum", "true_positives", "false_positives"]), [model, "subgroup"])


def _score_by_rows(matches: DataFrame, pred: DataFrame, gt: DataFrame, in_group: DataFrame, images: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """The same with a row per match and subgroup, for any number of subgroups and any type of id."""
    truth = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    truth = in_group.join(truth, "image_id").groupBy("subgroup").agg(F.sum("n").alias("ground_truth_boxes"))
    # only subgroups without truth need the number of images with boxes
    faceless = images.join(truth, "subgroup", "left_anti").select("subgroup")
    quiet = in_group.join(F.broadcast(faceless), "subgroup", "left_semi")
    flagged = pred.select("image_id", model).join(quiet, "image_id").distinct()
    flagged = flagged.groupBy(model, "subgroup").agg(F.count(F.lit(1)).alias("images_with_boxes"))
    base = (
        pred.select(model).distinct().crossJoin(images)
        .join(truth, "subgroup", "left").fillna(0, ["ground_truth_boxes"])
        .join(flagged, [model, "subgroup"], "left").fillna(0, ["images_with_boxes"])
    )
    rows = matches.select("image_id", model, "pred_id", "score", "true_positive").join(in_group, "image_id")
    scored = average_precision(rows, base.select(model, "subgroup", "ground_truth_boxes"), [model, "subgroup"],
                               at_most=pred.count())
    return base, scored


def slice_eval(pred: DataFrame, gt: DataFrame, membership: DataFrame, model: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every detector on every condition slice; ``overall`` is no slice."""
    slices = membership.filter(F.col("subgroup") != "overall")
    return score_subgroups(pred, gt, slices, model, threshold).select(model, "subgroup", "precision", "recall", "f1", "ap")


def membership_join(membership: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images and boxes per subgroup; boxes are counted per image before they meet the memberships of it."""
    per_image = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return membership.join(per_image, "image_id", "left").groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"))


def image_correct(pred: DataFrame, gt: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """An image with truth is correct when all of it is matched; one without, when nothing is predicted."""
    per_image = match_gt_order(pred, gt, threshold).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("gt_count"), F.count_if("matched").alias("matched_count"))
    predicted = pred.groupBy("image_id").agg(F.count(F.lit(1)).alias("prediction_count"))
    out = images.select("image_id").join(per_image, "image_id", "left").join(predicted, "image_id", "left")
    out = out.fillna(0)
    correct = F.when(F.col("gt_count") > 0, F.col("gt_count") == F.col("matched_count")).otherwise(
        F.col("prediction_count") == 0)
    return out.withColumn("correct", correct)


def mcnemar(first: DataFrame, second: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Paired 2x2 counts of ``correct``, chi-square with continuity correction, and its p-value.

    The p-value is the tail of chi-square with one degree of freedom,
    erfc(sqrt(chi2 / 2)), evaluated by a series on the grouped result rows.
    """
    paired = first.select(*keys, "image_id", F.col("correct").alias("a")).join(
        second.select(*keys, "image_id", F.col("correct").alias("b")), [*keys, "image_id"])
    counts = paired.groupBy(*keys).agg(
        F.count_if(F.col("a") & F.col("b")).alias("both_correct"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_second"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("both_wrong"),
    )
    split = F.col("only_first") + F.col("only_second")
    gap = F.abs(F.col("only_first") - F.col("only_second")) - 1
    counts = counts.withColumn("chi_square", F.when(split > 0, gap * gap / split).otherwise(F.lit(0.0)))
    return counts.withColumn(
        "p_value", F.when(split > 0, erfc(F.sqrt(F.col("chi_square") / 2))).otherwise(F.lit(1.0)))


@F.pandas_udf(T.DoubleType())
def erfc(values: pd.Series) -> pd.Series:
    """Complementary error function for the few rows of a result table."""
    return values.map(math.erfc)


def duplicate_pairs(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of predictions of one image with IoU of ``threshold`` or more (``overlap_counts`` only counts them).

    The pairs meet in grid cells, so boxes far apart in one image never pair up.
    """
    from frameops.operators.greedy import grid_pairs

    side = pred.select("image_id", "pred_id", "score", "x1", "y1", "x2", "y2")

    def prefixed(p: str) -> DataFrame:
        return side.select("image_id", *[F.col(c).alias(p + c) for c in side.columns if c != "image_id"])

    pairs = grid_pairs(prefixed("l_"), prefixed("r_"), ["image_id"])
    pairs = pairs.filter(F.col("l_pred_id") < F.col("r_pred_id")).withColumn("iou", iou("l_", "r_"))
    return pairs.filter(F.col("iou") >= threshold).select(
        "image_id", F.col("l_pred_id").alias("first_id"), F.col("r_pred_id").alias("second_id"),
        "iou", F.col("l_score").alias("first_score"), F.col("r_score").alias("second_score"))


def _candidate_truth_pairs(boxes: DataFrame, gt: DataFrame, box_id: str, keep: Sequence[str] = ()) -> DataFrame:
    from frameops.operators.greedy import grid_pairs

    left = boxes.select("image_id", *[F.col(c).alias("l_" + c) for c in (box_id, "x1", "y1", "x2", "y2", *keep)])
    right = gt.select("image_id", *[F.col(c).alias("r_" + c) for c in ("gt_id", "x1", "y1", "x2", "y2")])
    return grid_pairs(left, right, ["image_id"]).withColumn("iou", iou("l_", "r_"))


def truth_label(boxes: DataFrame, gt: DataFrame, box_id: str, threshold: float = 0.5) -> DataFrame:
    """1 when any truth box of the image reaches the threshold."""
    best = _candidate_truth_pairs(boxes, gt, box_id).filter(F.col("iou") >= threshold)
    hit = best.select("image_id", F.col(f"l_{box_id}").alias(box_id)).distinct().withColumn("label", F.lit(1))
    return boxes.join(hit, ["image_id", box_id], "left").fillna(0, ["label"])


def recoverability(missed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate box for every missed truth box, with flags at IoU .5, .4 and .3."""
    pairs = _candidate_truth_pairs(candidates, missed, "pred_id", ("score", "source"))
    best = pairs.groupBy("image_id", F.col("r_gt_id").alias("gt_id")).agg(
        F.max(F.struct("iou", F.col("l_score").alias("score"), F.col("l_source").alias("source"),
                       F.col("l_pred_id").alias("pred_id"))).alias("best"))
    out = missed.select("image_id", "gt_id").join(best, ["image_id", "gt_id"], "left")
    top = F.coalesce(F.col("best.iou"), F.lit(0.0))
    return out.select(
        "image_id", "gt_id", top.alias("best_iou"), F.col("best.source").alias("best_source"),
        F.coalesce(F.col("best.score"), F.lit(0.0)).alias("best_score"),
        *[(top >= t).alias(f"recoverable_{int(t * 100):02d}") for t in (0.5, 0.4, 0.3)])


def recoverability_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("missed_faces"),
        *[F.count_if(f"recoverable_{t}").alias(f"recoverable_{t}") for t in ("50", "40", "30")],
        F.avg("best_iou").alias("mean_best_iou"))


def error_summary(pred: DataFrame, gt: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-image error counts with frame attributes."""
    matches = match_greedy(pred, gt, threshold)
    by_pred = matches.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_if("true_positive").alias("matched_count"),
        F.count_if("false_positive").alias("false_positive_count"))
    by_gt = gt.groupBy("image_id").agg(F.count(F.lit(1)).alias("gt_count"))
    pairs = overlap_counts(pred, threshold).withColumnRenamed("pairs", "duplicate_pair_count")
    out = frames.select("image_id", "day_id", "view_type", "camera_stream_id")
    for part in (by_gt, by_pred, pairs):
        out = out.join(part, "image_id", "left")
    counts = ["gt_count", "prediction_count", "matched_count", "false_positive_count", "duplicate_pair_count"]
    out = out.fillna(0, counts)
    return out.withColumns({
        "false_negative_count": F.col("gt_count") - F.col("matched_count"),
        "zero_face_image": F.col("gt_count") == 0})


def false_positive_rows(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """False positives, marked when their image has no truth at all."""
    with_truth = gt.select("image_id").distinct().withColumn("has_truth", F.lit(True))
    out = matches.filter("false_positive").join(with_truth, "image_id", "left")
    return out.withColumn("zero_face", F.col("has_truth").isNull()).drop("has_truth")


def false_negative_rows(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """Truth boxes no prediction took."""
    taken = matches.filter("true_positive").select("image_id", "gt_id")
    return gt.join(taken, ["image_id", "gt_id"], "left_anti")


def missed_audit(pred: DataFrame, gt: DataFrame, frames: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """Image- and face-level miss rates per attribute."""
    faces = match_gt_order(pred, gt, threshold).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("faces"), F.count_if(~F.col("matched")).alias("missed"))
    joined = frames.select("image_id", by).join(faces, "image_id")
    out = joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("face_images"), F.count_if(F.col("missed") > 0).alias("images_with_misses"),
        F.sum("faces").alias("faces"), F.sum("missed").alias("missed_faces"))
    return out.withColumns({
        "image_miss_rate": F.col("images_with_misses") / F.col("face_images"),
        "face_miss_rate": F.col("missed_faces") / F.col("faces")})
