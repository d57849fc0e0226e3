"""Joins of the evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.functions.labels import label_contains
from frameops.operators.scale import unsized
from frameops.operators.windows import keep_one


def metric_join(conditions: DataFrame, manifest: DataFrame, perceptual: DataFrame, reid: DataFrame,
                keys: Sequence[str] = ("image_id", "method")) -> DataFrame:
    """Conditions, method manifest, perceptual and re-id rows; all left joins."""
    out = unsized(conditions).join(unsized(manifest), keys[0], "left")
    for side in (perceptual, reid):
        out = out.join(unsized(side), list(keys), "left")
    return out


def cross_view_pairs(manifest: DataFrame) -> DataFrame:
    """Egocentric x exocentric frames of identical day and timestamp, valid frames only."""
    valid = manifest.filter(F.col("integrity_status") == "valid")
    ego = valid.filter(F.col("view_type") == "egocentric").select(
        "day_id", "timestamp_id", F.col("image_id").alias("egocentric_image_id"),
        F.col("relative_path").alias("egocentric_relative_path"), F.col("camera_stream_id").alias("egocentric_stream_id"),
        F.col("participant_id").alias("egocentric_participant_id"))
    exo = valid.filter(F.col("view_type") == "exocentric").select(
        "day_id", "timestamp_id", F.col("image_id").alias("exocentric_image_id"),
        F.col("relative_path").alias("exocentric_relative_path"), F.col("camera_stream_id").alias("exocentric_stream_id"))
    return unsized(ego).join(unsized(exo), ["day_id", "timestamp_id"])


def control_pairs(pairs: DataFrame, keys: Sequence[str] = ("day_id", "exocentric_stream_id")) -> DataFrame:
    """One mismatched-time control per pair.

    Pairs of one (day, exocentric stream) are put in time order and each takes
    the exocentric frame of the next different timestamp, wrapping around.  Only
    the distinct timestamps of a key are ordered, so nothing is multiplied.
    """
    stamps = pairs.groupBy(*keys, "timestamp_id").agg(F.min("exocentric_image_id").alias("control_exocentric_image_id"))
    window = Window.partitionBy(*keys).orderBy("timestamp_id")
    first = F.first(F.struct("timestamp_id", "control_exocentric_image_id")).over(
        window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = F.lead(F.struct("timestamp_id", "control_exocentric_image_id")).over(window)
    shifted = stamps.select(*keys, "timestamp_id", F.coalesce(following, first).alias("n"))
    shifted = shifted.filter(F.col("n.timestamp_id") != F.col("timestamp_id"))
    return pairs.join(shifted, [*keys, "timestamp_id"]).select(
        *pairs.columns, F.col("n.timestamp_id").alias("control_timestamp_id"), "n.control_exocentric_image_id")


def anti_keys(df: DataFrame, others: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of the other tables."""
    return reduce(lambda d, o: d.join(o.select(key), key, "left_anti"), others, df)


def join_validated(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str, how: str = "left") -> DataFrame:
    """Join after checking that keys are unique where ``validate`` says so (one_to_one, many_to_one, ...)."""
    sides = validate.split("_to_")
    if len(sides) != 2 or not set(sides) <= {"one", "many"}:
        raise ValueError(f"unknown validation {validate}")
    for side, df, name in zip(sides, (left, right), ("left", "right"), strict=True):
        if side == "one":
            repeated = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).take(1)
            if repeated:
                raise ValueError(f"{name} keys are not unique for {validate}: {repeated[0].asDict()}")
    return left.join(right, list(on), how)


def profile_lookup(rows: DataFrame, profiles: DataFrame, focus: str = "focus") -> DataFrame:
    """Operators of each row's objective (profiles has a handful of rows)."""
    return rows.join(F.broadcast(profiles), focus, "left")


def tier_lookup(rows: DataFrame, tiers: DataFrame, vram: str = "vram_mb", cuda: str = "cuda") -> DataFrame:
    """The highest tier whose minimum memory fits.

    ``tiers``: tier, min_vram_mb, requires_cuda.  The few tiers become one sorted
    array literal, so no row is multiplied.
    """
    table = tiers.agg(F.sort_array(F.collect_list(F.struct("min_vram_mb", "requires_cuda", "tier")), asc=False).alias("__t"))
    fits = lambda t: (F.col(vram) >= t["min_vram_mb"]) & (~t["requires_cuda"] | F.col(cuda))
    chosen = F.get(F.filter("__t", fits), F.lit(0))["tier"]
    return rows.crossJoin(F.broadcast(table)).withColumn("tier", chosen).drop("__t")


def eligibility_join(eligibility: DataFrame, five_case: DataFrame, review: DataFrame) -> DataFrame:
    """Eligibility with the five-case fail rate and the author review fail rate per method."""
    five = five_case.groupBy("method").agg(
        F.count(F.lit(1)).alias("five_case_n"), F.count_if(F.lower("default_route_pass").isin("no", "0", "false")).alias("five_case_fails"))
    out = eligibility.join(five, "method", "left").join(review, "method", "left").fillna(0, ["five_case_n", "five_case_fails"])
    rate = F.when(F.col("five_case_n") > 0, F.col("five_case_fails") / F.col("five_case_n"))
    return out.withColumn("five_case_fail_rate", rate)


# fixed values: (flag, category column, category value, label token)
REVIEW_FLAGS = (
    ("no_face", "face_count_category", "no_face", None),
    ("single_face", "face_count_category", "single_face", None),
    ("multi_face", "face_count_category", "multi_face", None),
    ("small_face", "face_scale_category", "small", "small"),
    ("medium_face", "face_scale_category", "medium", "medium"),
    ("large_face", "face_scale_category", "large", "large"),
    ("mixed_scale_face", "face_scale_category", "mixed_scale", "mixed_scale"),
    ("very_small_or_distant_face", "face_scale_category", "very_small_or_distant", "very_small_or_distant"),
    ("edge_or_partial_face", "edge_partial_face", "yes", "edge_or_partial"),
    ("profile_or_occluded_face", "profile_occluded_face", "yes", "profile_or_occluded"),
    ("downward_egocentric_view", "downward_egocentric_view", "yes", "downward_egocentric"),
    ("motion_blur_or_low_sharpness", "blur_low_sharpness", "yes", "motion_blur_or_low_sharpness"),
    ("low_light_or_dim", "low_light_dim", "yes", "low_light"),
    ("high_clutter", "clutter_level", "high", "clutter_high"),
)


def condition_frame(base: DataFrame, reviewed: DataFrame, risk: DataFrame, key: str = "image_id") -> DataFrame:
    """Locked frames with fourteen reviewed flags and the risk state."""
    text = F.coalesce(F.col("condition_label"), F.lit(""))
    flags = {}
    for name, column, value, token in REVIEW_FLAGS:
        equal = F.coalesce(F.lower(column) == value, F.lit(False))
        flags[f"manual_{name}"] = equal if token is None else equal | label_contains(text, token)
    manual = reviewed.withColumns(flags).select(key, "box_count", *flags)
    return base.select(key).join(manual, key, "left").join(risk, key, "left")


def label_source_hybrid(base: DataFrame, model: DataFrame, key: str, labels: Sequence[str], from_model: Sequence[str]) -> DataFrame:
    """Per label the column of the base or of the model predictions."""
    side = model.select(key, *[F.col(c).alias(f"__{c}") for c in from_model])
    return base.join(side, key).select(key, *[F.col(f"__{c}").alias(c) if c in from_model else F.col(c) for c in labels])


def scr_box_hybrid(geometry: DataFrame, scene: DataFrame, key: str, geometry_labels: Sequence[str],
                   context_labels: Sequence[str]) -> DataFrame:
    """Geometry labels from boxes and context labels from the scene model, each falling back to the other, then 0."""
    g = geometry.select(key, *[F.col(c).alias(f"g_{c}") for c in geometry.columns if c != key])
    s = scene.select(key, *[F.col(c).alias(f"s_{c}") for c in scene.columns if c != key])
    out = g.join(s, key, "full_outer")

    def pick(name: str, first: str, second: str) -> Column:
        options = [F.col(f"{p}_{name}") for p in (first, second) if f"{p}_{name}" in out.columns]
        return F.coalesce(*options, F.lit(0)).alias(name)

    return out.select(key, *[pick(c, "g", "s") for c in geometry_labels], *[pick(c, "s", "g") for c in context_labels])


def concat_methods(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union by name, the last table wins per key."""
    tagged = [df.withColumn("__i", F.lit(i)) for i, df in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_one(rows, keys, [F.col("__i").desc()]).drop("__i")


def union_sources(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """Sorted union of two id sets."""
    return a.select(key).union(b.select(key)).distinct().orderBy(key)


def intersect_images(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """Ids in both sets."""
    return a.select(key).intersect(b.select(key))


def except_paths(requested: DataFrame, index: DataFrame, key: str = "relative_path") -> DataFrame:
    """Requested ids that the index lacks."""
    return requested.select(key).subtract(index.select(key))


def multi_key_sort(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Mixed ascending and descending sort, optionally the top rows only."""
    out = df.orderBy(*order)
    return out if n is None else out.limit(n)


def pivot_scores(rows: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """Matrix of one value per (row, column); a fixed column list avoids a pass over the data."""
    return rows.groupBy(row).pivot(column, list(values)).agg(F.first(value))
