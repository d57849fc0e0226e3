"""Per-image feature tables and summaries (A01-A10, A12-A21, A26-A31) and label metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.functions.geometry import area, scale_label, side_x, side_y
from frameops.functions.labels import gap_delta, gap_ratio, status_success, strictly_ordered
from frameops.operators.boxes import cluster_boxes
from frameops.operators.matching import f_score, ratio
from frameops.operators.scale import broadcast_if_small, exact_quantiles, null_safe_join

C = F.col


def with_frame(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    return boxes.join(frames.select("image_id", C("width").cast("double").alias("w"), C("height").cast("double").alias("h")), "image_id")


def _per_frame(frames: DataFrame, features: DataFrame) -> DataFrame:
    """All frames; frames without boxes get zeros."""
    return frames.select("image_id").join(features, "image_id", "left").fillna(0)


def geometry_features(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Eleven geometry features per frame."""
    rows = with_frame(boxes, frames)
    share, tall = area() / (C("w") * C("h")), side_y() / C("h")
    cx, cy = (C("x1") + C("x2")) / 2.0 / C("w"), (C("y1") + C("y2")) / 2.0 / C("h")
    edge = (C("x1") / C("w") < 0.05) | (C("y1") / C("h") < 0.05) | (C("x2") / C("w") > 0.95) | (C("y2") / C("h") > 0.95)
    out = rows.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("face_count"), F.max(share).alias("max_area_ratio"), F.avg(share).alias("mean_area_ratio"),
        F.min(share).alias("min_area_ratio"), F.sum(share).alias("coverage_ratio"), F.max(tall).alias("max_height_ratio"),
        F.avg(tall).alias("mean_height_ratio"), F.count_if(edge).alias("edge_count"), F.count_if(cy > 0.62).alias("lower_count"),
        F.count_if(cy < 0.38).alias("upper_count"), F.count_if(cx.between(0.33, 0.67) & cy.between(0.33, 0.67)).alias("center_count"))
    return _per_frame(frames, out)


def box_telemetry(boxes: DataFrame, frames: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Twenty features per detector, one column group per source (fixed source list, one shuffle)."""
    rows = with_frame(boxes, frames)
    share = area() / F.greatest(C("w") * C("h"), F.lit(1.0))
    wide, tall = side_x() / F.greatest(C("w"), F.lit(1.0)), side_y() / F.greatest(C("h"), F.lit(1.0))
    cx, cy = (C("x1") + C("x2")) / 2.0 / C("w"), (C("y1") + C("y2")) / 2.0 / C("h")
    edge = (C("x1") <= 0.02 * C("w")) | (C("y1") <= 0.02 * C("h")) | (C("x2") >= 0.98 * C("w")) | (C("y2") >= 0.98 * C("h"))
    center = (cx > 0.33) & (cx < 0.67) & (cy > 0.33) & (cy < 0.67)
    aggs = []
    for s in sources:
        mine = C("source") == s
        pick = lambda e: F.when(mine, e)  # noqa: E731, B023
        zero = lambda e: F.coalesce(e, F.lit(0.0))
        aggs += [F.when(F.count_if(mine) > 0, 1.0).otherwise(0.0).alias(f"{s}_any"), F.count_if(mine).cast("double").alias(f"{s}_count")]
        for name, value, stats in (("score", C("score"), ("max", "mean", "min", "std")), ("area", share, ("max", "mean", "min", "std")),
                                   ("height", tall, ("max", "mean")), ("width", wide, ("max", "mean"))):
            fns = {"max": F.max, "mean": F.avg, "min": F.min, "std": F.stddev_pop}
            aggs += [zero(fns[k](pick(value))).alias(f"{s}_{name}_{k}") for k in stats]
        for name, test in (("edge", edge), ("lower_frame", cy > 0.65), ("upper_frame", cy < 0.35), ("center", center), ("small", share < 0.0025), ("large", share > 0.04)):
            aggs.append(F.count_if(mine & test).cast("double").alias(f"{s}_{name}_count"))
    return _per_frame(frames, rows.groupBy("image_id").agg(*aggs))


def _spread(values: Sequence[Column]) -> Column:
    """Population standard deviation over a short list of columns."""
    mean = reduce(lambda a, b: a + b, values) / len(values)
    return F.sqrt(reduce(lambda a, b: a + b, [(v - mean) * (v - mean) for v in values]) / len(values))


def candidate_telemetry(boxes: DataFrame, frames: DataFrame, sources: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Per-source counts and scores, their spread, and cluster consensus per frame."""
    aggs = []
    for s in sources:
        mine = C("source") == s
        aggs += [F.count_if(mine).alias(f"{s}_count"), F.coalesce(F.max(F.when(mine, C("score"))), F.lit(0.0)).alias(f"{s}_score_max"),
                 F.coalesce(F.avg(F.when(mine, C("score"))), F.lit(0.0)).alias(f"{s}_score_mean"),
                 F.coalesce(F.avg(F.when(mine, area())), F.lit(0.0)).alias(f"{s}_area_mean")]
    per_frame = boxes.groupBy("image_id").agg(*aggs, F.count(F.lit(1)).alias("total_boxes"), F.avg("score").alias("score_mean"))
    clusters = cluster_boxes(boxes, threshold).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("cluster_count"), F.max(F.size("sources")).alias("cluster_sources_max"), F.avg(F.size("sources")).alias("cluster_sources_mean"),
        F.avg("members").alias("cluster_size_mean"), F.count_if(F.size("sources") == 1).alias("singleton_clusters"),
        F.count_if(F.size("sources") >= 3).alias("consensus_clusters"))
    out = _per_frame(frames, per_frame.join(clusters, "image_id"))
    counts = [C(f"{s}_count") for s in sources]
    return out.withColumns({
        "count_mean": reduce(lambda a, b: a + b, counts) / len(counts), "count_std": _spread(counts),
        "count_range": F.greatest(*counts) - F.least(*counts),
        "sources_with_boxes": reduce(lambda a, b: a + b, [F.when(c > 0, 1).otherwise(0) for c in counts]),
        "disagreement_ratio": C("singleton_clusters") / F.greatest(F.lit(1), C("cluster_count"))})


def disagreement_features(telemetry: DataFrame, small: str, big: str, other: str) -> DataFrame:
    """Agreement between two scales of one detector and another detector, from A02 columns."""
    counts = [C(f"{s}_count") for s in (small, big, other)]
    areas = {s: C(f"{s}_area_max") for s in (small, big, other)}
    edges = [C(f"{s}_edge_count") for s in (small, big, other)]
    top, low = F.greatest(*counts), F.least(*counts)
    num = lambda test: F.when(test, 1.0).otherwise(0.0)
    return telemetry.select(
        "image_id", low.alias("count_min"), top.alias("count_max"), (top - low).alias("count_range"), _spread(counts).alias("count_std"),
        (counts[1] - counts[0]).alias("scale_count_gain"), (counts[2] - counts[0]).alias("other_vs_small_gain"), (counts[2] - counts[1]).alias("other_vs_big_gain"),
        num(top > 0).alias("any_found"), num(top == 0).alias("none_found"), num(top - low >= 2).alias("count_disagreement"),
        num((top > 0) & (low == 0)).alias("any_disagreement"), (areas[big] - areas[small]).alias("scale_area_gain"),
        (areas[other] - areas[small]).alias("other_area_gain"), F.greatest(*edges).alias("edge_max"), (F.greatest(*edges) - F.least(*edges)).alias("edge_range"))


def _clamped(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    rows = with_frame(boxes, frames)
    at = lambda c, limit: F.greatest(F.lit(0.0), F.least(C(limit), C(c).cast("double")))
    rows = rows.withColumns({"cx1": at("x1", "w"), "cy1": at("y1", "h"), "cx2": at("x2", "w"), "cy2": at("y2", "h")})
    bw, bh = F.greatest(F.lit(1.0), C("cx2") - C("cx1")), F.greatest(F.lit(1.0), C("cy2") - C("cy1"))
    edge = ((C("cx1") <= 0.03 * C("w")) | (C("cy1") <= 0.03 * C("h")) | (C("cx2") >= C("w") - 0.03 * C("w")) | (C("cy2") >= C("h") - 0.03 * C("h")))
    return rows.withColumns({"area_ratio": bw * bh / (C("w") * C("h")), "height_ratio": bh / C("h"), "width_ratio": bw / C("w"),
                             "aspect_ratio": bh / bw, "center_y_ratio": (C("cy1") + C("cy2")) / 2.0 / C("h"), "on_edge": edge})


def box_summary_features(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Min, mean, max and population std of six box measures, counts, ranges and coverage."""
    measures = ("area_ratio", "height_ratio", "width_ratio", "aspect_ratio", "center_y_ratio", "score")
    stats = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_pop}
    aggs = [fn(m).alias(f"{m}_{k}") for m in measures for k, fn in stats.items()]
    out = _clamped(boxes, frames).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("face_count"), *aggs, F.count_if("on_edge").alias("edge_count"), F.count_if(C("center_y_ratio") >= 0.62).alias("lower_count"),
        F.count_if(C("center_y_ratio") <= 0.38).alias("upper_count"), F.sum("area_ratio").alias("coverage_ratio"))
    out = out.withColumns({"area_ratio_range": C("area_ratio_max") / F.greatest(C("area_ratio_min"), F.lit(1e-9)), "score_range": C("score_max") - C("score_min")})
    return _per_frame(frames, out)


def labels_from_boxes(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Count, scale, edge and downward labels from the boxes of a frame."""
    rows = _clamped(boxes, frames).withColumn("scale", scale_label(C("area_ratio"), C("height_ratio")))
    has = lambda s: F.max(F.when(C("scale") == s, 1).otherwise(0))
    out = rows.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), has("very_small_or_distant").alias("v"), has("small").alias("s"), has("medium").alias("m"), has("large").alias("l"),
        F.max("area_ratio").alias("hi"), F.min("area_ratio").alias("lo"), F.max(F.when(C("on_edge"), 1).otherwise(0)).alias("edge"), F.max("center_y_ratio").alias("cy"))
    out = frames.select("image_id").join(out, "image_id", "left").fillna(0)
    gap = ((C("v") == 1) & ((C("m") == 1) | (C("l") == 1))) | ((C("s") == 1) & (C("l") == 1)) | (C("hi") / F.greatest(C("lo"), F.lit(1e-9)) >= 10.0)
    mixed = (C("n") >= 2) & gap
    num = lambda test: F.when(test, 1).otherwise(0)
    plain = ~mixed & (C("n") > 0)
    return out.select(
        "image_id", num(C("n") == 0).alias("no_face"), num(C("n") == 1).alias("single_face"), num(C("n") >= 2).alias("multi_face"), num(mixed).alias("mixed_scale_face"),
        num(plain & (C("l") == 1)).alias("large_face"), num(plain & (C("l") == 0) & (C("m") == 1)).alias("medium_face"),
        num(plain & (C("l") == 0) & (C("m") == 0) & (C("s") == 1)).alias("small_face"),
        num(plain & (C("l") == 0) & (C("m") == 0) & (C("s") == 0)).alias("very_small_or_distant_face"),
        C("edge").alias("edge_or_partial_face"), num((C("n") > 0) & (C("cy") >= 0.62)).alias("downward_egocentric_view"))


def quantile_cues(df: DataFrame, by: str, sharpness: str, brightness: str, density: str) -> DataFrame:
    """Blur, low light and clutter classes from thresholds per protocol (20 %, 20 %, 66 % and 33 %)."""
    blur = exact_quantiles(df, [by], sharpness, {"q_blur": 0.20})
    light = exact_quantiles(df, [by], brightness, {"q_light": 0.20})
    clutter = exact_quantiles(df, [by], density, {"q_high": 0.66, "q_low": 0.33})
    # a protocol without any value of a signal has no threshold for it
    out = df
    for thresholds in (blur, light, clutter):
        out = null_safe_join(out, broadcast_if_small(thresholds), [by], "left")
    level = F.when(C(density) >= C("q_high"), "high").when(C(density) <= C("q_low"), "low").otherwise("medium")
    num = lambda test: F.when(test, 1).otherwise(0)
    return out.withColumns({"motion_blur_or_low_sharpness": num(C(sharpness) <= C("q_blur")), "low_light_or_dim": num(C(brightness) <= C("q_light")),
                            "high_clutter": num(C(density) >= C("q_high")), "clutter_level": level}).drop("q_blur", "q_light", "q_high", "q_low")


def conflict_features(model: DataFrame, rules: DataFrame, labels: Sequence[str], geometry: Sequence[str], key: str = "image_id") -> DataFrame:
    """Per-label disagreement of model and rule, and the number of geometry conflicts."""
    side = rules.select(key, *[C(k).alias(f"r_{k}") for k in labels])
    out = model.join(side, key).select(key, *[F.when(C(k) != C(f"r_{k}"), 1).otherwise(0).alias(f"conflict_{k}") for k in labels])
    return out.withColumn("geometry_conflicts", reduce(lambda a, b: a + b, [C(f"conflict_{k}") for k in geometry]))


#: Boxes whose crops one task takes.
CROP_BOXES = 250_000


def frame_crops(metrics: DataFrame, boxes: DataFrame, per_task: int = CROP_BOXES) -> DataFrame:
    """A09 input: every box of a frame under every method of it.

    Both sides are dealt by the number of boxes, so a task sums a bounded number of frames and methods. Spark would deal them by
    their bytes before the join, and the table of a task's sums would grow with the input.
    """
    tasks = max(-(-boxes.count() // per_task), boxes.sparkSession.sparkContext.defaultParallelism)
    return metrics.repartition(tasks, "image_id").join(boxes.repartition(tasks, "image_id"), "image_id")


def reid_per_frame(crops: DataFrame) -> DataFrame:
    """Crop rows (cosine, hit) to means and counts per frame and method."""
    return crops.groupBy("image_id", "method").agg(F.avg("cosine").alias("cosine_mean"), F.avg("hit").alias("reid_rate"), F.count(F.lit(1)).alias("face_crop_count"))


def perceptual_summary(rows: DataFrame, metrics: Sequence[str] = ("ssim", "lpips")) -> DataFrame:
    """A10: mean, population std and count per method."""
    aggs = [fn(m).alias(f"{m}_{k}") for m in metrics for k, fn in (("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))]
    return rows.groupBy("method").agg(*aggs)


def method_summary(scored: DataFrame, means: Sequence[str]) -> DataFrame:
    """Rows, successes and means per method."""
    return scored.groupBy("method").agg(F.count(F.lit(1)).alias("n_images"), F.sum("success").alias("n_success"), *[F.avg(c).alias(c) for c in means])


def policy_summary(rows: DataFrame) -> DataFrame:
    """Mean scores, distinct methods and the method distribution per policy."""
    per = rows.groupBy("policy", "selected_method").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("score", "privacy", "utility")])
    out = per.groupBy("policy").agg(
        F.sum("n").alias("n_images"), *[(F.sum(c) / F.sum("n")).alias(f"mean_{c}") for c in ("score", "privacy", "utility")],
        F.count(F.lit(1)).alias("n_methods"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("selected_method", "n")))).alias("method_distribution"))
    return out


def distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("image_count"))


def mode_summary(log: DataFrame, key: str = "objective_mode", means: Sequence[str] = ("actual_privacy_score", "actual_utility_score")) -> DataFrame:
    """Ok and failed counts and means per objective."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("n_input_frames"), F.count_if(C("status") == "ok").alias("n_success"),
                                F.count_if(C("status") != "ok").alias("n_failure"), *[F.avg(c).alias(f"mean_{c}") for c in means])


def runtime_summary(rows: DataFrame, keys: Sequence[str] = ("method",), seconds: str = "runtime_seconds") -> DataFrame:
    """Mean, median, total and failures."""
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean_seconds"), F.sum(seconds).alias("total_seconds"),
                                   F.count_if(~status_success(C("status"))).alias("failures"))
    return base.join(exact_quantiles(rows, list(keys), seconds, {"median_seconds": 0.5}), list(keys), "left")


def stage_timings(rows: DataFrame) -> DataFrame:
    """Seconds per stage."""
    return rows.groupBy("stage").agg(F.sum("seconds").alias("seconds"))


def signal_summary(df: DataFrame, label: str, signal: str) -> DataFrame:
    """Count, median and mean of a quality signal per label."""
    base = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"), F.avg(signal).alias("mean"))
    return base.join(exact_quantiles(df, [label], signal, {"median": 0.5}), label)


def signal_readiness(summary: DataFrame, label: str, order: Sequence[str], min_ratio: Sequence[float] = (), min_gap: float = 0.0,
                     zero_face_rate: Column | None = None) -> DataFrame:
    """A signal is ready when its medians rise strictly, far enough apart, with at most 10 % zero-face rows."""
    wide = summary.groupBy().pivot(label, list(order)).agg(F.first("median"))
    values = [C(v) for v in order]
    ready = strictly_ordered(values)
    for i, r in enumerate(min_ratio):
        ready = ready & (gap_ratio(values[i], values[i + 1]) >= r)
    if min_gap:
        for a, b in zip(values, values[1:], strict=False):
            ready = ready & (gap_delta(a, b) >= min_gap)
    if zero_face_rate is not None:
        ready = ready & (zero_face_rate <= 0.10)
    return wide.withColumn("ready", F.coalesce(ready, F.lit(False)))


def review_rollup(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Provenance counts per method and the author fail rate."""
    author = C("provenance_class") == "structured_author_inspection"
    return rows.groupBy("method").agg(
        *[F.count_if(C("provenance_class") == k).alias(k) for k in classes], F.count(F.lit(1)).alias("reviews"),
        ratio(F.count_if(author & (C("failed") == 1)), F.count_if(author)).alias("author_fail_rate"))


def qualitative_summary(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean scores (four places), fails, recommendation counts, first recommendation and number of notes per method."""
    counts = [F.count_if(C("recommendation") == r).alias(f"{r}_count") for r in ("promote", "retain", "demote")]
    return rows.groupBy("method").agg(
        *[F.round(F.avg(s), 4).alias(f"{s}_mean") for s in scores], F.sum("failed").alias("fail_count"), *counts,
        F.min_by("recommendation", "review_id").alias("first_recommendation"), F.count(F.nullif("note", F.lit(""))).alias("note_count"))


def protocol_summary(rows: DataFrame) -> DataFrame:
    """Rows, unique images, reviewed rows and boxes per protocol."""
    per_image = rows.groupBy("protocol", "image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("reviewed").alias("r"), F.sum("box_count").alias("b"))
    return per_image.groupBy("protocol").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_images"), F.sum("r").alias("reviewed_rows"), F.sum("b").alias("boxes"))


def proxy_correlation(rows: DataFrame, proxy: str, reference: str, floor: float = 0.80) -> DataFrame:
    """Pearson r of proxy and reference scores per method, means, missing references and acceptance."""
    both = C(proxy).isNotNull() & C(reference).isNotNull()
    out = rows.groupBy("method").agg(
        F.count_if(both).alias("paired"), F.count_if(C(reference).isNull()).alias("missing"), F.corr(F.when(both, C(proxy)), F.when(both, C(reference))).alias("pearson_r"),
        F.avg(F.when(both, C(proxy))).alias("proxy_mean"), F.avg(F.when(both, C(reference))).alias("reference_mean"))
    out = out.withColumn("acceptable", F.coalesce(C("pearson_r") >= floor, F.lit(False)))
    overall = out.agg(F.bool_and("acceptable").alias("overall_acceptable"))
    return out.crossJoin(F.broadcast(overall))


def detection_totals(boxes: DataFrame) -> DataFrame:
    """Boxes and images with boxes per kind."""
    return boxes.groupBy("kind", "image_id").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(
        F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("images_with_boxes"))


def method_scorecard(runtime: DataFrame, perceptual: DataFrame, reid: DataFrame) -> DataFrame:
    """One row per method from three summaries."""
    return runtime.join(perceptual, "method", "full_outer").join(reid, "method", "full_outer")


def failure_accounting(expected: DataFrame, outputs: DataFrame, inputs: DataFrame, benign: Sequence[str]) -> DataFrame:
    """Labelled failures, missing outputs, missing inputs and zero-box frames.

    ``outputs``: image_id, failure_label, box_count.  ``inputs``: image_id.
    """
    out = expected.select("image_id").join(outputs.withColumn("__o", F.lit(1)), "image_id", "left").join(inputs.select("image_id", F.lit(1).alias("__i")), "image_id", "left")
    labelled = C("failure_label").isNotNull() & ~C("failure_label").isin(*benign)
    totals = out.agg(F.count(F.lit(1)).alias("frames"), F.count_if(labelled).alias("labelled_failures"), F.count_if(C("__o").isNull()).alias("missing_outputs"),
                     F.count_if(C("__i").isNull()).alias("missing_inputs"), F.count_if(C("box_count") == 0).alias("zero_box_frames"))
    return totals.withColumn("failures", C("labelled_failures") + C("missing_outputs") + C("missing_inputs"))


def run_totals(rows: DataFrame, counters: Sequence[str]) -> DataFrame:
    """(counter, value, rows) of several categorical columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), C(c).cast("string").alias("value")) for c in counters])
    return rows.select("box_count", F.inline(pairs)).groupBy("counter", "value").agg(F.count(F.lit(1)).alias("rows"), F.sum("box_count").alias("boxes"))


# label metrics


def confusion_long(truth: DataFrame, pred: DataFrame, labels: Sequence[str], key: str = "image_id") -> DataFrame:
    """(key, label, t, p) rows of two wide 0/1 tables."""
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), C(k).alias("t"), C(f"p_{k}").alias("p")) for k in labels])
    return truth.join(pred.select(key, *[C(k).alias(f"p_{k}") for k in labels]), key).select(key, F.inline(pairs))


def label_metrics(rows: DataFrame, minimum: int = 30) -> DataFrame:
    """Per-label support, precision, recall, F1, F2 and route eligibility."""
    c = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(C("t") * C("p")).alias("tp"))
    c = c.withColumns({"precision": ratio(C("tp"), C("predicted")), "recall": ratio(C("tp"), C("support"))})
    c = c.withColumns({"f1": f_score(C("precision"), C("recall")), "f2": f_score(C("precision"), C("recall"), 2.0)})
    return c.withColumn("route_eligible", (C("support") >= minimum) & (C("f1") >= 0.70) & (C("recall") >= 0.70))


def multilabel_metrics(truth: DataFrame, pred: DataFrame, labels: Sequence[str], minimum: int = 30, key: str = "image_id") -> DataFrame:
    """Macro F2 and F1, micro F2, sample Jaccard, exact match and composite over supported labels."""
    rows = confusion_long(truth, pred, labels, key)
    per_label = label_metrics(rows, minimum).filter(C("support") >= minimum)
    macro = per_label.agg(F.avg("f2").alias("macro_f2"), F.avg("f1").alias("macro_f1"), ratio(F.sum("tp"), F.sum("predicted")).alias("p"), ratio(F.sum("tp"), F.sum("support")).alias("r"))
    supported = rows.join(F.broadcast(per_label.select("label")), "label", "left_semi")
    hit, either = F.sum(C("t") * C("p")), F.sum(F.greatest("t", "p"))
    sample = supported.groupBy(key).agg(
        F.when(either == 0, 1.0).otherwise(F.try_divide(hit, either)).alias("jaccard"), F.min(F.when(C("t") == C("p"), 1).otherwise(0)).alias("exact"))
    out = macro.crossJoin(sample.agg(F.avg("jaccard").alias("sample_jaccard"), F.avg("exact").alias("exact_match")))
    out = out.withColumn("micro_f2", f_score(C("p"), C("r"), 2.0)).drop("p", "r")
    # fixed values: weights of the composite
    return out.withColumn("composite", 0.50 * C("macro_f2") + 0.25 * C("macro_f1") + 0.15 * C("micro_f2") + 0.10 * C("sample_jaccard"))


def label_family_means(per_label: DataFrame, families: Mapping[str, Sequence[str]], minimum: int = 30) -> DataFrame:
    """Means per label family over supported labels."""
    family = F
    for name, labels in families.items():
        family = family.when(C("label").isin(*labels), F.lit(name))
    rows = per_label.filter(C("support") >= minimum).withColumn("family", family.otherwise(F.lit("other")))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("labels"), *[F.avg(m).alias(f"mean_{m}") for m in ("precision", "recall", "f1", "f2")],
                                      F.count_if("route_eligible").alias("route_eligible_labels"))


def best_f2_threshold(scores: DataFrame, keys: Sequence[str] = (), low: float = 0.10, high: float = 0.90, points: int = 33) -> DataFrame:
    """The lowest threshold of the grid with the best F2, per key.

    ``scores``: keys, probability, label.  Rows are counted per grid step first,
    so the grid multiplies a table of at most ``points`` + 1 rows per key.
    """
    step = (high - low) / (points - 1)
    grid = F.array(*[F.lit(low + i * step) for i in range(points)])
    reached = F.size(F.filter(grid, lambda t: C("probability") >= t))
    binned = scores.groupBy(*keys, reached.alias("reached")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = binned.select("*", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("i"))
    per = steps.groupBy(*keys, "i").agg(F.sum("pos").alias("support"), F.sum(F.when(C("reached") >= C("i"), C("n")).otherwise(0)).alias("predicted"),
                                        F.sum(F.when(C("reached") >= C("i"), C("pos")).otherwise(0)).alias("tp"))
    per = per.withColumn("f2", f_score(ratio(C("tp"), C("predicted")), ratio(C("tp"), C("support")), 2.0))
    best = per.groupBy(*keys).agg(F.min(F.struct((-F.round("f2", 12)).alias("v"), "i")).alias("b"))
    return best.select(*keys, F.element_at(grid, C("b.i")).alias("threshold"), (-C("b.v")).alias("f2"))


def gate_confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Detected, missed and flagged counts with miss and fallback rates; ``label`` and ``prediction`` are 0/1."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum("label").alias("artifacts"), F.sum(C("label") * C("prediction")).alias("detected"),
        F.sum(C("label") * (1 - C("prediction"))).alias("missed"), F.sum((1 - C("label")) * C("prediction")).alias("flagged_clean"),
        F.avg(C("label") * (1 - C("prediction"))).alias("miss_rate"), F.avg("prediction").alias("fallback_rate"))
