"""Labels, flags, text and path expressions."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: hard-condition labels and their flag columns, in order
CONDITION_FLAGS = (
    ("small_face", "small_face_flag"), ("motion_blur", "motion_blur_flag"), ("extreme_pose", "extreme_pose_flag"),
    ("downward_view", "downward_view_flag"), ("visible_screen", "visible_screen_flag"),
    ("visible_text", "visible_text_flag"), ("multiple_faces", "multiple_faces_flag"), ("no_face", "no_face_flag"),
)
# fixed values: order in which a frame's category is chosen
CATEGORY_PRIORITY = (
    "single_face", "very_small_or_distant_face", "large_face", "motion_blur_or_low_sharpness", "small_face",
    "medium_face", "mixed_scale_face", "edge_or_partial_face", "profile_or_occluded_face", "low_light_or_dim",
    "high_clutter", "multi_face", "downward_egocentric_view",
)
SUCCESS_STATES = ("ok", "existing", "completed", "copied")


def stable_order(seed: int, key: Column) -> Column:
    """Fixed-width hash prefix that orders rows the same way everywhere."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def flag(value: Column) -> Column:
    """Yes/no spellings as a boolean."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def is_4k(width: Column, height: Column) -> Column:
    """At least 3840x2160 in either orientation."""
    return ((width >= 3840) & (height >= 2160)) | ((width >= 2160) & (height >= 3840))


def face_size_bucket(size: Column) -> Column:
    """F13."""
    return F.when(size <= 0, "none").when(size < 30, "small").when(size < 80, "medium").otherwise("large")


def occlusion_bucket(value: Column) -> Column:
    """F13."""
    return F.when(value <= 0.0, "low").when(value <= 0.25, "medium").otherwise("high")


def condition_membership(flags: Sequence[tuple[str, str]] = CONDITION_FLAGS) -> Column:
    """labels whose flag is set, in fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(column), F.lit(label)) for label, column in flags]))


def compose_label(parts: Sequence[Column]) -> Column:
    """non-empty labels joined by a pipe."""
    return F.concat_ws("|", F.array_compact(F.array(*[F.nullif(p, F.lit("")) for p in parts])))


def label_contains(text: Column, token: str, column: Column | None = None, equals: str | None = None) -> Column:
    """F16: plain substring of the label text, or equality of a category column."""
    hit = F.coalesce(text.contains(token), F.lit(False))
    return hit if column is None else hit | F.coalesce(column == F.lit(equals or token), F.lit(False))


def path_part(path: Column, i: int) -> Column:
    """The i-th path part, null when the path is shorter."""
    return F.get(F.split(path, "/"), F.lit(i))


def infer_metadata(path: Column) -> dict[str, Column]:
    """day, stream, participant and view from a relative path of at least four parts."""
    deep = F.size(F.split(path, "/")) >= 4
    member = path_part(path, 1) == "members"
    some = lambda value: F.when(deep, value).otherwise(F.lit(""))
    return {
        "day_id": some(path_part(path, 0)),
        "camera_stream_id": some(path_part(path, 2)),
        "participant_id": some(F.when(member, path_part(path, 2)).otherwise(F.lit("none"))),
        "view_type": some(F.when(member, "egocentric").otherwise(F.lit("exocentric"))),
    }


def event_seconds(stem: Column) -> Column:
    """seconds into the day of a stem HH_NNNN, one frame every five seconds."""
    hour, index = F.substring(stem, 1, 2).cast("bigint"), F.substring(stem, 4, 4).cast("bigint")
    return hour * 3600 + (index - 1) * 5


def event_time(day: Column, stem: Column) -> Column:
    """F18 as a timestamp on ``day``."""
    return day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), event_seconds(stem).cast("decimal(18,6)"))


def normalise_focus(value: Column) -> Column:
    """privacy, balanced or utility; balanced when unknown."""
    # fixed values: accepted aliases
    aliases = {"privacy": "privacy", "privacy-focused": "privacy", "privacy_first": "privacy",
               "utility": "utility", "utility-focused": "utility", "utility_priority": "utility",
               "balanced": "balanced", "utility_under_privacy_floor": "balanced"}
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit("balanced"))


def first_true_category(prefix: str = "", confident_no_face: Column | None = None) -> Column:
    """the first set flag in priority order, multi_face without any."""
    picks = [F.when(F.col(prefix + name) == 1, F.lit(name)) for name in CATEGORY_PRIORITY]
    chosen = F.coalesce(*picks, F.lit("multi_face"))
    return chosen if confident_no_face is None else F.when(confident_no_face, F.lit("no_face")).otherwise(chosen)


def status_success(status: Column) -> Column:
    """F21."""
    return F.lower(status).isin(*SUCCESS_STATES)


def confidence_summary(scores: Column) -> Column:
    """min/max/mean at four places, or not_available."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores)
    places = lambda c: F.format_string("%.4f", c)
    text = F.concat_ws("/", places(F.array_min(scores)), places(F.array_max(scores)), places(mean))
    return F.when(F.size(scores) > 0, text).otherwise(F.lit("not_available"))


# fixed values: pose tokens, in the order they are looked for
POSE_TOKENS = ("downward", "extreme_pose", "side_face", "profile", "small_face", "multi_face", "multiple_faces")


def infer_pose(labels: Column, recommendation: Column, height: Column) -> Column:
    """sorted labels joined by +, else the first token found, else small_face below 150 px."""
    joined = F.nullif(F.array_join(F.array_sort(F.array_distinct(labels)), "+"), F.lit(""))
    found = [F.when(recommendation.contains(t), F.lit(t)) for t in POSE_TOKENS]
    small = F.when((height > 0) & (height < 150), F.lit("small_face"))
    return F.coalesce(joined, *found, small, F.lit("unknown"))


@F.pandas_udf(T.DoubleType())
def _matching_ratio(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([
        None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()
        for a, b in zip(before, after, strict=True)], dtype="float64")


def text_similarity(before: Column, after: Column, method: str = "ratio") -> Column:
    """similarity in [0, 1] of trimmed texts; both empty 1, exactly one empty 0.

    ``ratio`` is the matching-blocks ratio of the standard library in Arrow
    batches; ``levenshtein`` stays in the JVM.
    """
    a, b = F.trim(F.coalesce(before, F.lit(""))), F.trim(F.coalesce(after, F.lit("")))
    if method == "levenshtein":
        value = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    else:
        value = _matching_ratio(a, b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(value)


def gap_ratio(lower: Column, upper: Column) -> Column:
    """upper over lower; without a positive lower value infinite, or 1 when upper is not positive either."""
    return F.when(lower > 0, F.try_divide(upper, lower)).when(upper > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))


def gap_delta(lower: Column, upper: Column) -> Column:
    """separation of two medians as a difference."""
    return upper - lower


def strictly_ordered(values: Sequence[Column]) -> Column:
    """each value below the next."""
    return reduce(lambda a, b: a & b, [x < y for x, y in zip(values, values[1:], strict=False)])


def classify_provenance(source: Column, reviewer: Column) -> dict[str, Column]:
    """review class from the rating source and reviewer, with independent and automated marks."""
    # fixed values: source prefixes, source names, reviewer name and classes
    source = F.lower(source)
    generated = source.startswith("partner_residual_edge") | source.startswith("author_residual_edge")
    inherited = source.startswith("partner_align_author_fail")
    manual = source.isin("dual20_partner_human", "diffusion_quality_pass2", "partner_five_case_independent")
    kind = (F.when(generated, "heuristic_or_automatically_generated")
            .when(inherited, "inherited_or_reused_review_result")
            .when(manual, "genuine_manual_partner_review")
            .when(reviewer == "author", "structured_author_inspection")
            .otherwise("joint_or_adjudicated_manual_review"))
    return {
        "provenance_class": kind,
        "independent": F.when(~generated & ~inherited & manual, "not_established").otherwise("no"),
        "automated": F.when(generated, "yes").otherwise("no"),
    }


def apply_alias(method: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """application ids of a method; the method itself when it has none."""
    table = F.create_map(*[x for k, ids in aliases.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in ids]))])
    return F.coalesce(F.try_element_at(table, method), F.array(method))


def source_group(path: Column) -> Column:
    """day/camera/hour grouping key."""
    return F.concat_ws("/", path_part(path, 0), path_part(path, 2), path_part(path, 3))


def condition_score(condition: str) -> Column:
    """Sortable confidence of one hard condition."""
    c = F.col
    bonus = lambda name: F.when(c(name), F.lit(1000.0)).otherwise(F.lit(0.0))
    if condition == "small_face":
        near = bonus("small_face_flag") + F.greatest(F.lit(0.0), 80.0 - c("min_face_size_px"))
        return F.when(c("face_count") <= 0, F.lit(-1.0)).otherwise(near)
    if condition == "motion_blur":
        return -c("blur_score") + c("face_count") * 25.0
    if condition == "extreme_pose":
        return bonus("extreme_pose_flag") + c("occlusion_ratio_value") * 10.0
    if condition == "downward_view":
        return bonus("downward_view_flag") + c("largest_face_size_px") / F.lit(10.0)
    if condition == "visible_screen":
        place = (F.when(c("camera_stream_id").isin("meeting", "reading"), 6.0)
                 .when(c("camera_stream_id").isin("living1", "living2"), -8.0).otherwise(F.lit(0.0)))
        return c("screen_score") * 100.0 + c("text_score") * 0.35 + place
    if condition == "visible_text":
        return c("text_score") * 3.0 + F.least(c("blur_score") / 150.0, F.lit(10.0)) - c("screen_score") * 10.0
    if condition == "multiple_faces":
        return c("face_count").cast("double")
    if condition == "no_face":
        return (bonus("no_face_flag") - c("screen_score") * 20.0 - c("text_score")
                + F.least(c("blur_score") / 200.0, F.lit(5.0)))
    return F.lit(0.0)


def condition_filter(condition: str) -> Column:
    """Rows eligible for one condition bank."""
    c = F.col
    if condition == "motion_blur":
        return c("motion_blur_flag") & (c("face_count") > 0) & (c("screen_score") < 0.20)
    if condition == "visible_screen":
        near = c("visible_screen_flag") | (c("screen_score") >= 0.08) | ((c("text_score") >= 12) & ~c("motion_blur_flag"))
        return near & (c("text_score") <= 40) & (c("face_count") > 0)
    if condition == "visible_text":
        return c("visible_text_flag") & ~c("motion_blur_flag") & (c("text_score") >= 12)
    if condition == "small_face":
        return c("face_count") > 0
    if condition == "no_face":
        return c("no_face_flag") & (c("screen_score") < 0.12) & (c("text_score") <= 5)
    if condition == "multiple_faces":
        return c("multiple_faces_flag") & (c("face_count") >= 3)
    return c(f"{condition}_flag")
