"""Queries on scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.functions import geometry as G
from frameops.functions import labels as L
from frameops.operators import boxes as X
from frameops.plans.registry import query
from frameops.plans.sql_greedy import iou_sql, suppress_ctes

CORNERS = ["x1", "y1", "x2", "y2"]


def pairs(v):
    """Each candidate beside the truth box of its line, when both exist."""
    left = v.pred_boxes.select("image_id", "pred_id", F.floor(F.col("pred_id") / 3).alias("gt_id"), *[F.col(c).alias(f"a_{c}") for c in CORNERS])
    right = v.gt_boxes.select("image_id", "gt_id", *[F.col(c).alias(f"b_{c}") for c in CORNERS])
    return left.join(right, ["image_id", "gt_id"])


PAIR = "pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id AND p.pred_id // 3 = g.gt_id"


@query("f01_iou", f"SELECT p.image_id, p.pred_id, {iou_sql('p', 'g')} AS iou FROM {PAIR}", dbl="iou")
def _(v):
    return pairs(v).select("image_id", "pred_id", G.iou("a_", "b_").alias("iou"))


@query("f02_iou_floor", f"SELECT p.image_id, p.pred_id, {iou_sql('p', 'g')} AS iou FROM {PAIR}", dbl="iou")
def _(v):
    return pairs(v).select("image_id", "pred_id", G.iou_floor("a_", "b_").alias("iou"))


FRAMED = "cand_boxes b JOIN frames f ON b.image_id = f.image_id"


def framed(v):
    return v.cand_boxes.join(v.frames.select("image_id", "width", "height"), "image_id")


@query("f03_clamp_box", f"""SELECT * FROM (SELECT b.image_id, pred_id, least(greatest(x1, 0), width) AS x1, least(greatest(y1, 0), height) AS y1,
  least(greatest(x2, 0), width) AS x2, least(greatest(y2, 0), height) AS y2 FROM {FRAMED}) WHERE x2 > x1 AND y2 > y1""")
def _(v):
    return X.clamp_boxes(framed(v)).select("image_id", "pred_id", *CORNERS)


@query("f04_scale_boxes", "SELECT image_id, pred_id, " + ", ".join(f"CAST(trunc({c} * 0.37) AS BIGINT) AS {c}" for c in CORNERS) + " FROM pred_boxes")
def _(v):
    return v.pred_boxes.withColumns(G.scale_boxes(0.37)).select("image_id", "pred_id", *CORNERS)


@query("f05_box_metrics", """SELECT image_id, gt_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area,
  CAST(x2 - x1 AS DOUBLE) / (y2 - y1) AS aspect_ratio, x1 + (x2 - x1) / 2.0 AS center_x, y1 + (y2 - y1) / 2.0 AS center_y,
  least(x2 - x1, y2 - y1) AS min_side, greatest(x2 - x1, y2 - y1) AS max_side FROM gt_boxes""",
       dbl="width height area aspect_ratio center_x center_y min_side max_side")
def _(v):
    return v.gt_boxes.withColumns(G.box_metrics()).drop(*CORNERS)


@query("f06_edge_touching", "SELECT image_id, pred_id, x1 <= 16 OR y1 <= 16 OR x2 >= 3824 OR y2 >= 2144 AS touching FROM cand_boxes")
def _(v):
    return v.cand_boxes.select("image_id", "pred_id", G.edge_touching(16).alias("touching"))


@query("f07_postfilter", """SELECT image_id, pred_id FROM cand_boxes WHERE NOT ((x1 <= 32 OR y1 <= 32 OR x2 >= 3808 OR y2 >= 2128)
  AND least(x2 - x1, y2 - y1) >= 160 AND score <= 0.5)""")
def _(v):
    return v.cand_boxes.filter(~G.postfilter_drop(32, 160, 0.5)).select("image_id", "pred_id")


@query("f08_polygon_bbox", f"""SELECT b.image_id, pred_id, greatest(0, x1 - 3) AS x1, greatest(0, y1) AS y1, least(width, x2) AS x2, least(height, y2 + 5) AS y2 FROM {FRAMED}""")
def _(v):
    c = F.col
    corners = [("x1", 0, "y1", 0), ("x2", 0, "y1", 2), ("x2", -1, "y2", 5), ("x1", -3, "y2", 0)]
    points = F.array(*[F.struct((c(x) + dx).cast("double").alias("x"), (c(y) + dy).cast("double").alias("y")) for x, dx, y, dy in corners])
    return framed(v).select("image_id", "pred_id", G.polygon_bbox(points, c("width"), c("height")).alias("b")).select("image_id", "pred_id", "b.*")


@query("f09_keep_recognised_text", f"""SELECT b.image_id, pred_id FROM {FRAMED} JOIN part ON p_partkey = pred_id // 3 // 512 // 100000
WHERE length(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) >= 3 AND score >= 0.3 AND x2 - x1 >= 8 AND y2 - y1 >= 6
  AND CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) <= 0.08""")
def _(v):
    part_key = F.expr("pred_id div 3 div 512 div 100000")
    text = v.table("part").select(F.col("p_partkey"), F.col("p_name").alias("text"))
    rows = framed(v).withColumn("p_partkey", part_key).join(text, "p_partkey")
    return X.keep_recognised_text(rows).select("image_id", "pred_id")


SCREENS = f"""scr AS MATERIALIZED (SELECT b.* FROM {FRAMED} WHERE CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) BETWEEN 0.0008 AND 0.55
  AND NOT (score < 0.12 AND CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) > 0.02)),"""
TEXTS = f"""scr AS MATERIALIZED (SELECT b.* FROM {FRAMED} WHERE x2 - x1 >= 8 AND y2 - y1 >= 8 AND CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) BETWEEN 0.00015 AND 0.12
  AND NOT (greatest(x2 - x1, y2 - y1) > 0.55 * greatest(width, height) AND CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) > 0.04)),"""


@query("f10_filter_screens", "SELECT image_id, pred_id FROM seeded WHERE seed = pred_id",
       ctes=SCREENS + suppress_ctes("scr", 0.5, "score DESC, pred_id", "pred_id"))
def _(v):
    return X.filter_screens(framed(v)).select("image_id", "pred_id")


@query("f11_filter_texts", """SELECT image_id, pred_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS rk
  FROM seeded WHERE seed = pred_id) WHERE rk <= 40""", ctes=TEXTS + suppress_ctes("scr", 0.4, "score DESC, pred_id", "pred_id"))
def _(v):
    return X.filter_texts(framed(v)).select("image_id", "pred_id")


SCALE_SQL = """CASE WHEN hf < 0.065 OR af < 0.003 THEN 'very_small_or_distant' WHEN hf < 0.13 OR af < 0.0085 THEN 'small'
  WHEN hf < 0.25 OR af < 0.022 THEN 'medium' ELSE 'large' END"""


@query("f12_scale_label", f"""SELECT image_id, gt_id, {SCALE_SQL} AS scale FROM (SELECT g.image_id, gt_id,
  CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (width * height) AS af, CAST(y2 - y1 AS DOUBLE) / height AS hf FROM gt_boxes g JOIN frames f ON g.image_id = f.image_id)""")
def _(v):
    rows = v.gt_boxes.join(v.frames.select("image_id", "width", "height"), "image_id")
    label = G.scale_label(G.area() / (F.col("width") * F.col("height")), G.side_y() / F.col("height"))
    return rows.select("image_id", "gt_id", label.alias("scale"))


@query("f13_buckets", """SELECT image_id, CASE WHEN largest_face_size_px <= 0 THEN 'none' WHEN largest_face_size_px < 30 THEN 'small'
  WHEN largest_face_size_px < 80 THEN 'medium' ELSE 'large' END AS face_size, CASE WHEN occlusion_ratio_value <= 0 THEN 'low'
  WHEN occlusion_ratio_value <= 0.25 THEN 'medium' ELSE 'high' END AS occlusion FROM quality_frame""")
def _(v):
    return v.quality_frame.select("image_id", L.face_size_bucket(F.col("largest_face_size_px")).alias("face_size"),
                                  L.occlusion_bucket(F.col("occlusion_ratio_value")).alias("occlusion"))


MATCHES_SQL = "concat_ws('|', " + ", ".join(f"CASE WHEN {col} THEN '{label}' END" for label, col in L.CONDITION_FLAGS) + ")"


@query("f14_condition_membership", f"SELECT image_id, {MATCHES_SQL} AS matches FROM quality_frame")
def _(v):
    return v.quality_frame.select("image_id", F.array_join(L.condition_membership(), "|").alias("matches"))


@query("f15_compose_label", """SELECT image_id, concat_ws('|', CASE WHEN single_face = 1 THEN 'single_face' END,
  CASE WHEN small_face = 1 THEN 'small' END, CASE WHEN high_clutter = 1 THEN 'clutter_high' END) AS label FROM conditions""")
def _(v):
    parts = [F.when(F.col(k) == 1, F.lit(t)).otherwise(F.lit("")) for k, t in
             (("single_face", "single_face"), ("small_face", "small"), ("high_clutter", "clutter_high"))]
    return v.conditions.select("image_id", L.compose_label(parts).alias("label"))


@query("f16_label_contains", """SELECT image_id, contains(concat_ws('|', CASE WHEN small_face = 1 THEN 'small' END, CASE WHEN high_clutter = 1 THEN 'clutter_high' END), 'clutter_high')
  OR participant_id = 'p3' AS flag FROM conditions""")
def _(v):
    text = L.compose_label([F.when(F.col("small_face") == 1, F.lit("small")), F.when(F.col("high_clutter") == 1, F.lit("clutter_high"))])
    return v.conditions.select("image_id", L.label_contains(text, "clutter_high", F.col("participant_id"), "p3").alias("flag"))


@query("f17_infer_metadata", """SELECT relative_path, day_id, camera_stream_id, CASE WHEN view_type = 'egocentric' THEN camera_stream_id ELSE 'none' END AS participant_id, view_type FROM manifest""")
def _(v):
    return v.manifest.select("relative_path").withColumns(L.infer_metadata(F.col("relative_path")))


@query("f18_event_time", """SELECT image_id, CAST(epoch(TIMESTAMP '2024-03-01' + to_seconds(CAST(CAST(substr(timestamp_id, 1, 2) AS BIGINT) * 3600
  + (CAST(substr(timestamp_id, 4, 4) AS BIGINT) - 1) * 5 AS BIGINT))) AS BIGINT) AS event_epoch FROM frames""")
def _(v):
    stamp = L.event_time(F.lit("2024-03-01"), F.col("timestamp_id"))
    return v.frames.select("image_id", F.unix_seconds(stamp).alias("event_epoch"))


@query("f19_normalise_focus", """SELECT image_id, CASE WHEN lower(trim(d)) IN ('privacy', 'privacy_first') THEN 'privacy'
  WHEN lower(trim(d)) IN ('utility_priority', 'utility') THEN 'utility' ELSE 'balanced' END AS focus
FROM (SELECT image_id, CASE substr(camera_stream_id, 1, 1) WHEN 'p' THEN ' Privacy_First ' WHEN 'l' THEN 'UTILITY_PRIORITY' WHEN 'm' THEN 'balanced' ELSE 'other' END AS d FROM frames)""")
def _(v):
    first = F.substring("camera_stream_id", 1, 1)
    raw = F.when(first == "p", " Privacy_First ").when(first == "l", "UTILITY_PRIORITY").when(first == "m", "balanced").otherwise("other")
    return v.frames.select("image_id", L.normalise_focus(raw).alias("focus"))


CATEGORY_SQL = "coalesce(" + ", ".join(f"CASE WHEN {k} = 1 THEN '{k}' END" for k in L.CATEGORY_PRIORITY) + ", 'multi_face')"


@query("f20_first_true_category", f"SELECT image_id, CASE WHEN no_face = 1 AND box_count = 0 THEN 'no_face' ELSE {CATEGORY_SQL} END AS category FROM pred_conditions")
def _(v):
    sure = (F.col("no_face") == 1) & (F.col("box_count") == 0)
    return v.pred_conditions.select("image_id", L.first_true_category("", sure).alias("category"))


@query("f21_status_success", "SELECT image_id, method, status IN ('ok', 'existing', 'completed', 'copied') AS success FROM method_metrics")
def _(v):
    return v.method_metrics.select("image_id", "method", L.status_success(F.col("status")).alias("success"))


@query("f22_confidence_summary", """SELECT image_id, method, coalesce(printf('%.4f', low) || '/' || printf('%.4f', high) || '/' || printf('%.4f', mean), 'not_available') AS summary FROM (
  SELECT image_id, method, list_min(s) AS low, list_max(s) AS high, (list_sum(s) / len(s)) + 1e-9 AS mean FROM (
    SELECT image_id, method, list_filter([reid_a, reid_b, reid_c], lambda x: x IS NOT NULL) AS s FROM method_metrics))""")
def _(v):
    scores = F.array_compact(F.array("reid_a", "reid_b", "reid_c"))
    return v.method_metrics.select("image_id", "method", L.confidence_summary(scores).alias("summary"))


@query("f23_infer_pose", """SELECT image_id, CASE WHEN profile_or_occluded_face = 1 AND edge_or_partial_face = 1 THEN 'edge+profile' WHEN profile_or_occluded_face = 1 THEN 'profile'
  WHEN edge_or_partial_face = 1 THEN 'edge' WHEN downward_egocentric_view = 1 THEN 'downward' WHEN multi_face = 1 THEN 'multi_face'
  WHEN box_count * 60 > 0 AND box_count * 60 < 150 THEN 'small_face' ELSE 'unknown' END AS pose FROM conditions""")
def _(v):
    c = F.col
    labels = F.array_compact(F.array(F.when(c("profile_or_occluded_face") == 1, F.lit("profile")), F.when(c("edge_or_partial_face") == 1, F.lit("edge"))))
    hint = F.when(c("downward_egocentric_view") == 1, "use downward route").when(c("multi_face") == 1, "multi_face blur").otherwise("")
    return v.conditions.select("image_id", L.infer_pose(labels, hint, c("box_count") * 60).alias("pose"))


@query("f24_text_similarity", """SELECT doc_id, word, CASE WHEN trim(before) = '' AND trim(after) = '' THEN 1.0 WHEN trim(before) = '' OR trim(after) = '' THEN 0.0
  ELSE 1.0 - CAST(length(before) - length(replace(replace(replace(replace(replace(before, 'a', ''), 'e', ''), 'i', ''), 'o', ''), 'u', '')) AS DOUBLE) / greatest(length(trim(before)), length(trim(after)), 1) END AS similarity
FROM text_pairs""", dbl="similarity")
def _(v):
    # the pairs differ by one-for-one replacements, so their edit distance is the number of them
    return v.text_pairs.select("doc_id", "word", L.text_similarity(F.col("before"), F.col("after"), "levenshtein").alias("similarity"))


MEDIANS = """med AS (SELECT median(blur_score) FILTER (largest_face_size_px < 120) AS low, median(blur_score) FILTER (largest_face_size_px >= 120 AND largest_face_size_px < 180) AS mid,
  median(blur_score) FILTER (largest_face_size_px >= 180) AS high FROM quality_frame)"""


@query("f25_separation", """SELECT low, mid, high, mid / low AS ratio_low_mid, high - mid AS delta_mid_high, low < mid AND mid < high AS ordered FROM med""",
       ctes=MEDIANS, dbl="low mid high ratio_low_mid delta_mid_high")
def _(v):
    level = F.when(F.col("largest_face_size_px") < 120, "low").when(F.col("largest_face_size_px") < 180, "mid").otherwise("high")
    from frameops.operators.scale import exact_quantiles

    medians = exact_quantiles(v.quality_frame.withColumn("level", level), ["level"], "blur_score", {"m": 0.5})
    wide = medians.groupBy().pivot("level", ["low", "mid", "high"]).agg(F.first("m"))
    c = F.col
    return wide.select("low", "mid", "high", L.gap_ratio(c("low"), c("mid")).alias("ratio_low_mid"),
                       L.gap_delta(c("mid"), c("high")).alias("delta_mid_high"), L.strictly_ordered([c("low"), c("mid"), c("high")]).alias("ordered"))


@query("f26_classify_provenance", """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'heuristic_or_automatically_generated' WHEN source = 'src3' THEN 'inherited_or_reused_review_result'
  WHEN source = 'src4' THEN 'genuine_manual_partner_review' WHEN lang = 'en' THEN 'structured_author_inspection' ELSE 'joint_or_adjudicated_manual_review' END AS provenance_class,
  CASE WHEN source = 'src4' THEN 'not_established' ELSE 'no' END AS independent, CASE WHEN source IN ('src1', 'src2') THEN 'yes' ELSE 'no' END AS automated FROM documents""")
def _(v):
    s = F.col("source")
    rating = (F.when(s == "src1", "Partner_residual_edge_7").when(s == "src2", "author_residual_edge").when(s == "src3", "partner_align_author_fail_2")
              .when(s == "src4", "dual20_partner_human").otherwise("manual"))
    reviewer = F.when(F.col("lang") == "en", "author").otherwise("partner")
    return v.table("documents").select("doc_id", rating.alias("r"), reviewer.alias("w")).withColumns(
        L.classify_provenance(F.col("r"), F.col("w"))).drop("r", "w")


# fixed values: method to application ids
ALIASES = {"solid_mask_black": ["solid_mask"], "layered_blur_downscale_noise": ["layered"], "blur": ["blur"], "pixelate": ["pixelate"],
           "no_action_copy": ["copy"], "diffusion_low_step": ["diffusion"]}


@query("f27_apply_alias", """SELECT image_id, method, CASE method WHEN 'solid_mask_black' THEN 'solid_mask' WHEN 'layered_blur_downscale_noise' THEN 'layered'
  WHEN 'diffusion_low_step' THEN 'diffusion' ELSE method END AS app_ids FROM method_metrics""")
def _(v):
    return v.method_metrics.select("image_id", "method", F.array_join(L.apply_alias(F.col("method"), ALIASES), ",").alias("app_ids"))


@query("f28_tile_grid", """SELECT image_id, x AS tile_x, y AS tile_y FROM (SELECT image_id, unnest(list_distinct(list_append(range(0, greatest(width - 1280, 0) + 1, 960), greatest(width - 1280, 0)))) AS x, height FROM frames),
  LATERAL (SELECT unnest(list_distinct(list_append(range(0, greatest(height - 1280, 0) + 1, 960), greatest(height - 1280, 0)))) AS y)""", big="tile_x tile_y")
def _(v):
    grid = v.frames.withColumn("tile_x", F.explode(G.tile_offsets(F.col("width"), 1280, 320)))
    return grid.withColumn("tile_y", F.explode(G.tile_offsets(F.col("height"), 1280, 320))).select("image_id", "tile_x", "tile_y")


@query("f29_untile_boxes", "SELECT image_id, pred_id, x1, y1, x2, y2 FROM seeded WHERE seed = pred_id",
       ctes=suppress_ctes("cand_boxes", 0.5, "score DESC, pred_id", "pred_id"))
def _(v):
    # boxes in the coordinates of the 960 px tile that holds their corner
    c = F.col
    tile = {"tile_x": F.floor(c("x1") / 960) * 960, "tile_y": F.floor(c("y1") / 960) * 960}
    local = v.cand_boxes.withColumns(tile).withColumns({k: c(k) - c("tile_x" if k[0] == "x" else "tile_y") for k in CORNERS})
    return X.untile_boxes(local).select("image_id", "pred_id", *CORNERS)
