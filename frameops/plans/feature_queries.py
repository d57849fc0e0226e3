"""Queries on feature tables, summaries, label metrics, embeddings, pixels and text (A, E, L metrics, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.operators import features as A
from frameops.operators import joins as J
from frameops.operators import policy as D
from frameops.operators import raster as P
from frameops.operators import reconstructed as R
from frameops.operators import vectors as V
from frameops.operators.scale import unsized
from frameops.plans.box_queries import CLUSTER
from frameops.plans.policy_queries import CASCADE, ENH, cascaded, enhanced
from frameops.plans.registry import query
from frameops.plans.sql_greedy import suppress_ctes
from frameops.plans.table_queries import PAIRS
from frameops.plans.views import LABELS, SOURCES

C = F.col

GT_FRAME = "gt_boxes b JOIN frames f ON b.image_id = f.image_id"
GEO = f"""geo AS MATERIALIZED (SELECT b.image_id, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (CAST(width AS DOUBLE) * height) AS s, CAST(y2 - y1 AS DOUBLE) / height AS t, (x1 + x2) / 2.0 / width AS cx, (y1 + y2) / 2.0 / height AS cy,
  CAST(x1 AS DOUBLE) / width < 0.05 OR CAST(y1 AS DOUBLE) / height < 0.05 OR CAST(x2 AS DOUBLE) / width > 0.95 OR CAST(y2 AS DOUBLE) / height > 0.95 AS e FROM {GT_FRAME})"""


def zeros(cols: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols.split())


GEO_D = "max_area_ratio mean_area_ratio min_area_ratio coverage_ratio max_height_ratio mean_height_ratio"
GEO_N = "face_count edge_count lower_count upper_count center_count"


@query("a01_geometry_features", f"""SELECT image_id, {zeros(GEO_D + ' ' + GEO_N)} FROM frames LEFT JOIN (SELECT image_id, count(*) AS face_count, max(s) AS max_area_ratio, avg(s) AS mean_area_ratio, min(s) AS min_area_ratio, sum(s) AS coverage_ratio, max(t) AS max_height_ratio, avg(t) AS mean_height_ratio,
  count(*) FILTER (e) AS edge_count, count(*) FILTER (cy > 0.62) AS lower_count, count(*) FILTER (cy < 0.38) AS upper_count, count(*) FILTER (cx BETWEEN 0.33 AND 0.67 AND cy BETWEEN 0.33 AND 0.67) AS center_count FROM geo GROUP BY image_id) USING (image_id)""", ctes=GEO, dbl=GEO_D)
def _(v):
    return A.geometry_features(v.gt_boxes, v.frames)


TEL_SRC = """tel AS MATERIALIZED (SELECT b.*, CAST(greatest(0, x2 - x1) * greatest(0, y2 - y1) AS DOUBLE) / (CAST(width AS DOUBLE) * height) AS s, CAST(x2 - x1 AS DOUBLE) / width AS wr, CAST(y2 - y1 AS DOUBLE) / height AS hr, (x1 + x2) / 2.0 / width AS cx, (y1 + y2) / 2.0 / height AS cy,
  x1 <= 0.02 * width OR y1 <= 0.02 * height OR x2 >= 0.98 * width OR y2 >= 0.98 * height AS e FROM cand_boxes b JOIN frames f ON b.image_id = f.image_id)"""


def tel_cols(s: str) -> list[tuple[str, str]]:
    m = f"FILTER (source = '{s}')"
    both = f"FILTER (source = '{s}' AND {{}})"
    out = [(f"{s}_any", f"CASE WHEN count(*) {m} > 0 THEN 1.0 ELSE 0.0 END"), (f"{s}_count", f"count(*) {m}")]
    for name, col, stats in (("score", "score", "max mean min std"), ("area", "s", "max mean min std"), ("height", "hr", "max mean"), ("width", "wr", "max mean")):
        for k in stats.split():
            fn = {"max": "max", "mean": "avg", "min": "min", "std": "stddev_pop"}[k]
            out.append((f"{s}_{name}_{k}", f"{fn}({col}) {m}"))
    for name, test in (("edge", "e"), ("lower_frame", "cy > 0.65"), ("upper_frame", "cy < 0.35"), ("center", "cx > 0.33 AND cx < 0.67 AND cy > 0.33 AND cy < 0.67"), ("small", "s < 0.0025"), ("large", "s > 0.04")):
        out.append((f"{s}_{name}_count", f"count(*) {both.format(test)}"))
    return out


TEL_ALL = [p for s in SOURCES for p in tel_cols(s)]
TEL_NAMES = " ".join(n for n, _ in TEL_ALL)
TEL = TEL_SRC + ", telemetry AS MATERIALIZED (SELECT image_id, " + ", ".join(f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" for n, _ in TEL_ALL) + " FROM frames LEFT JOIN (SELECT image_id, " + ", ".join(f"{e} AS {n}" for n, e in TEL_ALL) + " FROM tel GROUP BY image_id) USING (image_id))"


@query("a02_box_telemetry", "SELECT * FROM telemetry", ctes=TEL, dbl=TEL_NAMES)
def _(v):
    return A.box_telemetry(v.cand_boxes, v.frames, SOURCES)


def std3(a: str, b: str, c: str) -> str:
    m = f"(({a} + {b} + {c}) / 3)"
    return f"sqrt((({a} - {m}) ** 2 + ({b} - {m}) ** 2 + ({c} - {m}) ** 2) / 3)"


A3 = [(f"{s}_{k}", e.format(m=f"FILTER (source = '{s}')")) for s in SOURCES for k, e in (("count", "count(*) {m}"), ("score_max", "max(score) {m}"), ("score_mean", "avg(score) {m}"), ("area_mean", "avg((x2 - x1) * (y2 - y1)) {m}"))]
A3_N = [n for n, _ in A3]
A3_D = " ".join([n for n in A3_N if not n.endswith("_count")] + ["score_mean", "cluster_sources_mean", "cluster_size_mean", "count_mean", "count_std", "disagreement_ratio"])
A3_I = " ".join([n for n in A3_N if n.endswith("_count")] + ["total_boxes", "cluster_count", "cluster_sources_max", "singleton_clusters", "consensus_clusters", "count_range", "sources_with_boxes"])
K3 = [f"{s}_count" for s in SOURCES]


@query("a03_candidate_telemetry", f"""SELECT *, ({' + '.join(K3)}) / 3.0 AS count_mean, {std3(*K3)} AS count_std, greatest({', '.join(K3)}) - least({', '.join(K3)}) AS count_range, {' + '.join(f'({k} > 0)::INT' for k in K3)} AS sources_with_boxes,
  CAST(singleton_clusters AS DOUBLE) / greatest(1, cluster_count) AS disagreement_ratio FROM (SELECT image_id, {zeros(' '.join(A3_N) + ' total_boxes score_mean cluster_count cluster_sources_max cluster_sources_mean cluster_size_mean singleton_clusters consensus_clusters')} FROM frames
  LEFT JOIN (SELECT image_id, {', '.join(f'{e} AS {n}' for n, e in A3)}, count(*) AS total_boxes, avg(score) AS score_mean FROM cand_boxes GROUP BY image_id) USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS cluster_count, max(source_count) AS cluster_sources_max, avg(source_count) AS cluster_sources_mean, avg(members) AS cluster_size_mean, count(*) FILTER (source_count = 1) AS singleton_clusters, count(*) FILTER (source_count >= 3) AS consensus_clusters FROM clusters GROUP BY image_id) USING (image_id))""",
       ctes=CLUSTER.replace("0.45", "0.5"), dbl=A3_D, big=A3_I)
def _(v):
    return A.candidate_telemetry(v.cand_boxes, v.frames, SOURCES)


A4 = {"count_min": "least(a, b, c)", "count_max": "greatest(a, b, c)", "count_range": "greatest(a, b, c) - least(a, b, c)", "count_std": std3("a", "b", "c"), "scale_count_gain": "b - a", "other_vs_small_gain": "c - a", "other_vs_big_gain": "c - b",
      "any_found": "CASE WHEN greatest(a, b, c) > 0 THEN 1.0 ELSE 0.0 END", "none_found": "CASE WHEN greatest(a, b, c) = 0 THEN 1.0 ELSE 0.0 END", "count_disagreement": "CASE WHEN greatest(a, b, c) - least(a, b, c) >= 2 THEN 1.0 ELSE 0.0 END",
      "any_disagreement": "CASE WHEN greatest(a, b, c) > 0 AND least(a, b, c) = 0 THEN 1.0 ELSE 0.0 END", "scale_area_gain": "scrfd_area_max - rfdetr_area_max", "other_area_gain": "yolo_area_max - rfdetr_area_max",
      "edge_max": "greatest(rfdetr_edge_count, scrfd_edge_count, yolo_edge_count)", "edge_range": "greatest(rfdetr_edge_count, scrfd_edge_count, yolo_edge_count) - least(rfdetr_edge_count, scrfd_edge_count, yolo_edge_count)"}


@query("a04_disagreement_features", "SELECT image_id, " + ", ".join(f"{e} AS {n}" for n, e in A4.items()) + " FROM (SELECT *, rfdetr_count AS a, scrfd_count AS b, yolo_count AS c FROM telemetry)", ctes=TEL, dbl=" ".join(A4))
def _(v):
    return A.disagreement_features(A.box_telemetry(v.cand_boxes, v.frames, SOURCES), "rfdetr", "scrfd", "yolo")


CLAMP = """clamped AS MATERIALIZED (SELECT image_id, w, h, score, bw * bh / (w * h) AS area_ratio, bh / h AS height_ratio, bw / w AS width_ratio, bh / bw AS aspect_ratio, (b1 + b2) / 2.0 / h AS center_y_ratio, a1 <= 0.03 * w OR b1 <= 0.03 * h OR a2 >= w - 0.03 * w OR b2 >= h - 0.03 * h AS on_edge FROM (
  SELECT *, greatest(1.0, a2 - a1) AS bw, greatest(1.0, b2 - b1) AS bh FROM (SELECT p.image_id, p.score, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h, greatest(0.0, least(CAST(width AS DOUBLE), x1)) AS a1, greatest(0.0, least(CAST(height AS DOUBLE), y1)) AS b1,
    greatest(0.0, least(CAST(width AS DOUBLE), x2)) AS a2, greatest(0.0, least(CAST(height AS DOUBLE), y2)) AS b2 FROM {src} p JOIN frames f ON p.image_id = f.image_id)))"""
A5 = [(f"{m}_{k}", f"{fn}({m})") for m in ("area_ratio", "height_ratio", "width_ratio", "aspect_ratio", "center_y_ratio", "score") for k, fn in (("min", "min"), ("mean", "avg"), ("max", "max"), ("std", "stddev_pop"))]


@query("a05_box_summary_features", f"""SELECT image_id, {zeros(' '.join(n for n, _ in A5) + ' face_count edge_count lower_count upper_count coverage_ratio area_ratio_range score_range')} FROM frames LEFT JOIN (
  SELECT *, area_ratio_max / greatest(area_ratio_min, 1e-9) AS area_ratio_range, score_max - score_min AS score_range FROM (SELECT image_id, {', '.join(f'{e} AS {n}' for n, e in A5)}, count(*) AS face_count, count(*) FILTER (on_edge) AS edge_count, count(*) FILTER (center_y_ratio >= 0.62) AS lower_count,
    count(*) FILTER (center_y_ratio <= 0.38) AS upper_count, sum(area_ratio) AS coverage_ratio FROM clamped GROUP BY image_id)) USING (image_id)""",
       ctes=CLAMP.format(src="pred_boxes"), dbl=" ".join(n for n, _ in A5) + " coverage_ratio area_ratio_range score_range")
def _(v):
    return A.box_summary_features(v.pred_boxes, v.frames)


@query("a06_labels_from_boxes", """SELECT image_id, (n = 0)::INT AS no_face, (n = 1)::INT AS single_face, (n >= 2)::INT AS multi_face, mixed::INT AS mixed_scale_face, (NOT mixed AND n > 0 AND l)::INT AS large_face, (NOT mixed AND n > 0 AND NOT l AND m)::INT AS medium_face,
  (NOT mixed AND n > 0 AND NOT l AND NOT m AND s)::INT AS small_face, (NOT mixed AND n > 0 AND NOT l AND NOT m AND NOT s)::INT AS very_small_or_distant_face, e::INT AS edge_or_partial_face, (n > 0 AND cy >= 0.62)::INT AS downward_egocentric_view FROM (
  SELECT image_id, coalesce(n, 0) AS n, coalesce(l, FALSE) AS l, coalesce(m, FALSE) AS m, coalesce(s, FALSE) AS s, coalesce(e, FALSE) AS e, coalesce(cy, 0) AS cy, coalesce(n >= 2 AND ((v AND (m OR l)) OR (s AND l) OR hi / greatest(lo, 1e-9) >= 10), FALSE) AS mixed FROM frames LEFT JOIN (
    SELECT image_id, count(*) AS n, bool_or(sc = 'v') AS v, bool_or(sc = 's') AS s, bool_or(sc = 'm') AS m, bool_or(sc = 'l') AS l, max(area_ratio) AS hi, min(area_ratio) AS lo, bool_or(on_edge) AS e, max(center_y_ratio) AS cy FROM (
      SELECT *, CASE WHEN height_ratio < 0.065 OR area_ratio < 0.003 THEN 'v' WHEN height_ratio < 0.13 OR area_ratio < 0.0085 THEN 's' WHEN height_ratio < 0.25 OR area_ratio < 0.022 THEN 'm' ELSE 'l' END AS sc FROM clamped) GROUP BY image_id) USING (image_id))""",
       ctes=CLAMP.format(src="pred_boxes"), big="no_face single_face multi_face mixed_scale_face large_face medium_face small_face very_small_or_distant_face edge_or_partial_face downward_egocentric_view")
def _(v):
    return A.labels_from_boxes(v.pred_boxes, v.frames)


@query("a07_quantile_cues", """SELECT image_id, (blur_score <= a)::INT AS motion_blur_or_low_sharpness, (brightness <= b)::INT AS low_light_or_dim, (webp_blockiness_score >= c)::INT AS high_clutter, CASE WHEN webp_blockiness_score >= c THEN 'high' WHEN webp_blockiness_score <= d THEN 'low' ELSE 'medium' END AS clutter_level
FROM quality_frame JOIN (SELECT view_type, quantile_cont(blur_score, 0.20) AS a, quantile_cont(brightness, 0.20) AS b, quantile_cont(webp_blockiness_score, 0.66) AS c, quantile_cont(webp_blockiness_score, 0.33) AS d FROM quality_frame GROUP BY view_type) USING (view_type)""",
       big="motion_blur_or_low_sharpness low_light_or_dim high_clutter")
def _(v):
    rows = v.quality_frame.select("image_id", "view_type", "blur_score", "brightness", "webp_blockiness_score")
    return A.quantile_cues(rows, "view_type", "blur_score", "brightness", "webp_blockiness_score").drop("view_type", "blur_score", "brightness", "webp_blockiness_score")


GEOM = ("no_face", "single_face", "multi_face", "small_face", "large_face")


@query("a08_conflict_features", "SELECT image_id, " + ", ".join(f"(c.{k} <> p.{k})::INT AS conflict_{k}" for k in (*GEOM, "high_clutter")) + ", " + " + ".join(f"(c.{k} <> p.{k})::INT" for k in GEOM) + " AS geometry_conflicts FROM pred_conditions p JOIN conditions c USING (image_id)",
       big=" ".join(f"conflict_{k}" for k in (*GEOM, "high_clutter")) + " geometry_conflicts")
def _(v):
    return A.conflict_features(v.pred_conditions, v.conditions, [*GEOM, "high_clutter"], GEOM)


@query("a09_reid_per_frame", "SELECT m.image_id, m.method, avg(m.reid_a * b.score) AS cosine_mean, avg(CASE WHEN m.reid_a * b.score >= 0.3 THEN 1.0 ELSE 0.0 END) AS reid_rate, count(*) AS face_crop_count FROM method_metrics m JOIN pred_boxes b USING (image_id) WHERE reid_a IS NOT NULL GROUP BY ALL", dbl="cosine_mean reid_rate")
def _(v):
    rows = v.method_metrics.filter(C("reid_a").isNotNull()).select("image_id", "method", "reid_a")
    crops = A.frame_crops(rows, v.pred_boxes.select("image_id", "score")).withColumn("cosine", C("reid_a") * C("score"))
    return A.reid_per_frame(crops.withColumn("hit", F.when(C("cosine") >= 0.3, 1.0).otherwise(0.0)))


@query("a10_perceptual_summary", "SELECT method, avg(ssim) AS ssim_mean, stddev_pop(ssim) AS ssim_std, count(ssim) AS ssim_n, avg(lpips) AS lpips_mean, stddev_pop(lpips) AS lpips_std, count(lpips) AS lpips_n FROM method_metrics GROUP BY method", dbl="ssim_mean ssim_std lpips_mean lpips_std")
def _(v):
    return A.perceptual_summary(v.method_metrics)


SUM7 = ("privacy3", "utility3", "face_region_utility", "background_preservation", "runtime_for_score", "enhanced_score", "high_compute_score")


@query("a12_method_summary", "SELECT method, count(*) AS n_images, sum(success) AS n_success, " + ", ".join(f"avg({c}) AS {c}" for c in SUM7) + " FROM enh GROUP BY method", ctes=ENH, dbl="n_success " + " ".join(SUM7))
def _(v):
    return A.method_summary(enhanced(v), SUM7)


def cascade_rows(v):
    return cascaded(v).withColumn("policy", F.lit("cascade"))


@query("a13_policy_summary", """SELECT 'cascade' AS policy, count(*) AS n_images, avg(score) AS mean_score, avg(privacy) AS mean_privacy, avg(utility) AS mean_utility, count(DISTINCT selected_method) AS n_methods,
  (SELECT string_agg(selected_method || '=' || CAST(n AS VARCHAR), ',' ORDER BY selected_method) FROM (SELECT selected_method, count(*) AS n FROM casc GROUP BY ALL)) AS method_distribution FROM casc""", ctes=ENH + "," + CASCADE, dbl="mean_score mean_privacy mean_utility")
def _(v):
    text = F.array_join(F.transform(F.map_entries("method_distribution"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return A.policy_summary(cascade_rows(v)).withColumn("method_distribution", text)


@query("a14_distribution", "SELECT selected_method, selection_reason, count(*) AS image_count FROM casc GROUP BY ALL", ctes=ENH + "," + CASCADE)
def _(v):
    return A.distribution(cascade_rows(v), ["selected_method", "selection_reason"])


@query("a15_mode_summary", "SELECT method AS objective_mode, count(*) AS n_input_frames, count(*) FILTER (status = 'ok') AS n_success, count(*) FILTER (status <> 'ok') AS n_failure, avg(privacy_score) AS mean_actual_privacy_score, avg(utility_score) AS mean_actual_utility_score FROM scored_metrics GROUP BY method",
       dbl="mean_actual_privacy_score mean_actual_utility_score")
def _(v):
    log = v.scored_metrics.select(C("method").alias("objective_mode"), "status", C("privacy_score").alias("actual_privacy_score"), C("utility_score").alias("actual_utility_score"))
    return A.mode_summary(log)


@query("a16_runtime_summary", "SELECT method, count(*) AS n, avg(runtime_seconds) AS mean_seconds, sum(runtime_seconds) AS total_seconds, count(*) FILTER (status = 'failed') AS failures, median(runtime_seconds) AS median_seconds FROM method_metrics GROUP BY method", dbl="mean_seconds total_seconds median_seconds")
def _(v):
    return A.runtime_summary(v.method_metrics)


@query("a17_stage_timings", "SELECT event_type AS stage, sum(value) AS seconds FROM events GROUP BY event_type", dbl="seconds")
def _(v):
    return A.stage_timings(v.table("events").select(C("event_type").alias("stage"), C("value").alias("seconds")))


LEVEL_SQL = "CASE WHEN largest_face_size_px < 120 THEN 'small' WHEN largest_face_size_px < 180 THEN 'medium' ELSE 'large' END"


def level_rows(v):
    size = C("largest_face_size_px")
    return v.quality_frame.filter(C("face_count") > 0).select("image_id", F.when(size < 120, "small").when(size < 180, "medium").otherwise("large").alias("level"), size.cast("double").alias("size"))


@query("a18_signal_summary", f"SELECT {LEVEL_SQL} AS level, count(*) AS count, avg(largest_face_size_px) AS mean, median(largest_face_size_px) AS median FROM quality_frame WHERE face_count > 0 GROUP BY 1", dbl="mean median")
def _(v):
    return A.signal_summary(level_rows(v), "level", "size")


@query("a18_signal_readiness", f"""SELECT small, medium, large, small < medium AND medium < large AND medium / small >= 1.25 AND large / medium >= 1.2 AND zero <= 0.10 AS ready FROM (
  SELECT median(largest_face_size_px) FILTER ({LEVEL_SQL} = 'small') AS small, median(largest_face_size_px) FILTER ({LEVEL_SQL} = 'medium') AS medium, median(largest_face_size_px) FILTER ({LEVEL_SQL} = 'large') AS large FROM quality_frame WHERE face_count > 0),
  (SELECT avg(CASE WHEN face_count = 0 THEN 1.0 ELSE 0.0 END) AS zero FROM quality_frame)""", dbl="small medium large")
def _(v):
    zero = v.quality_frame.agg(F.avg((C("face_count") == 0).cast("double")).alias("zero"))
    summary = A.signal_summary(level_rows(v), "level", "size")
    wide = A.signal_readiness(summary, "level", ["small", "medium", "large"], [1.25, 1.2])
    return wide.crossJoin(zero).select("small", "medium", "large", (C("ready") & (C("zero") <= 0.10)).alias("ready"))


CLASSES = ("heuristic_or_automatically_generated", "structured_author_inspection", "joint_or_adjudicated_manual_review")


def reviews(v):
    k = C("image_id") % 4
    kind = F.when(k == 0, CLASSES[0]).when(k == 1, CLASSES[1]).otherwise(CLASSES[2])
    rec = F.when(C("ssim") > 0.9, "promote").when(C("ssim") > 0.7, "retain").otherwise("demote")
    return v.method_metrics.select(C("image_id").alias("review_id"), "method", kind.alias("provenance_class"), (C("status") == "failed").cast("int").alias("failed"), "ssim", "lpips", rec.alias("recommendation"),
                                   F.when(C("image_id") % 5 == 0, "check edges").otherwise("").alias("note"))


REV = f"""rev AS MATERIALIZED (SELECT image_id AS review_id, method, CASE image_id % 4 WHEN 0 THEN '{CLASSES[0]}' WHEN 1 THEN '{CLASSES[1]}' ELSE '{CLASSES[2]}' END AS cls, (status = 'failed')::INT AS failed, ssim, lpips, CASE WHEN ssim > 0.9 THEN 'promote' WHEN ssim > 0.7 THEN 'retain' ELSE 'demote' END AS rec, image_id % 5 = 0 AS noted FROM method_metrics)"""


@query("a19_review_rollup", f"""SELECT method, {', '.join(f"count(*) FILTER (cls = '{k}') AS {k}" for k in CLASSES)}, count(*) AS reviews, CAST(count(*) FILTER (cls = '{CLASSES[1]}' AND failed = 1) AS DOUBLE) / count(*) FILTER (cls = '{CLASSES[1]}') AS author_fail_rate FROM rev GROUP BY method""", ctes=REV, dbl="author_fail_rate")
def _(v):
    return A.review_rollup(reviews(v), CLASSES)


@query("a20_qualitative_summary", """SELECT method, round(avg(ssim), 4) AS ssim_mean, round(avg(lpips), 4) AS lpips_mean, sum(failed) AS fail_count, count(*) FILTER (rec = 'promote') AS promote_count, count(*) FILTER (rec = 'retain') AS retain_count, count(*) FILTER (rec = 'demote') AS demote_count,
  arg_min(rec, review_id) AS first_recommendation, count(*) FILTER (noted) AS note_count FROM rev GROUP BY method""", ctes=REV, dbl="ssim_mean lpips_mean", big="fail_count")
def _(v):
    return A.qualitative_summary(reviews(v), ["ssim", "lpips"])


@query("a21_provenance_counts", "SELECT cls AS provenance_class, count(*) AS image_count FROM rev GROUP BY cls", ctes=REV)
def _(v):
    return A.distribution(reviews(v), ["provenance_class"])


@query("a26_protocol_summary", "SELECT view_type AS protocol, count(*) AS rows, count(DISTINCT image_id) AS unique_images, count(*) FILTER (integrity_status = 'valid') AS reviewed_rows, sum(box_count) AS boxes FROM frames JOIN conditions USING (image_id) JOIN membership USING (image_id) GROUP BY view_type", big="boxes")
def _(v):
    rows = v.frames.select("image_id", C("view_type").alias("protocol"), (C("integrity_status") == "valid").alias("reviewed")).join(v.conditions.select("image_id", "box_count"), "image_id")
    return A.protocol_summary(rows.join(v.membership.select("image_id"), "image_id"))


@query("a27_proxy_correlation", """SELECT p.*, coalesce(pearson_r >= 0.8, FALSE) AS acceptable, FALSE AS overall_acceptable FROM (SELECT method, count(*) FILTER (reid_a IS NOT NULL AND reid_b IS NOT NULL) AS paired, count(*) FILTER (reid_b IS NULL) AS missing, corr(reid_a, reid_b) AS pearson_r,
  avg(reid_a) FILTER (reid_b IS NOT NULL) AS proxy_mean, avg(reid_b) FILTER (reid_a IS NOT NULL) AS reference_mean FROM method_metrics GROUP BY method) p""", dbl="pearson_r proxy_mean reference_mean")
def _(v):
    return A.proxy_correlation(v.method_metrics, "reid_a", "reid_b")


@query("a28_detection_totals", "SELECT source AS kind, count(*) AS boxes, count(DISTINCT image_id) AS images_with_boxes FROM cand_boxes GROUP BY source")
def _(v):
    return A.detection_totals(v.cand_boxes.withColumn("kind", C("source")))


@query("a29_method_scorecard", "SELECT method, avg(runtime_seconds) AS mean_seconds, avg(ssim) AS ssim_mean, avg(reid_a) AS reid_mean FROM method_metrics GROUP BY method", dbl="mean_seconds ssim_mean reid_mean")
def _(v):
    m = v.method_metrics
    parts = [m.groupBy("method").agg(F.avg(c).alias(n)) for c, n in (("runtime_seconds", "mean_seconds"), ("ssim", "ssim_mean"), ("reid_a", "reid_mean"))]
    return A.method_scorecard(*parts)


@query("a30_failure_accounting", """SELECT frames, labelled_failures, missing_outputs, missing_inputs, zero_box_frames, labelled_failures + missing_outputs + missing_inputs AS failures FROM (SELECT count(*) AS frames, count(*) FILTER (day_id <> 'day12' AND lab IS NOT NULL AND lab <> 'benign') AS labelled_failures, count(*) FILTER (day_id = 'day12') AS missing_outputs,
  count(*) FILTER (integrity_status <> 'valid') AS missing_inputs, count(*) FILTER (day_id <> 'day12' AND box_count = 0) AS zero_box_frames FROM (SELECT f.day_id, f.integrity_status, c.box_count, CASE WHEN f.image_id % 17 = 0 THEN 'artifact' WHEN f.image_id % 17 = 1 THEN 'benign' END AS lab FROM frames f JOIN conditions c USING (image_id)))""")
def _(v):
    label = F.when(C("image_id") % 17 == 0, "artifact").when(C("image_id") % 17 == 1, "benign")
    outputs = v.conditions.filter(C("day_id") != "day12").select("image_id", label.alias("failure_label"), "box_count")
    return A.failure_accounting(v.frames, outputs, v.frames.filter(C("integrity_status") == "valid"), ["benign"])


@query("a31_run_totals", "SELECT 'status' AS counter, status AS value, count(*) AS rows, sum(box_count) AS boxes FROM method_metrics GROUP BY status UNION ALL SELECT 'method', method, count(*), sum(box_count) FROM method_metrics GROUP BY method", big="boxes")
def _(v):
    return A.run_totals(v.method_metrics, ["status", "method"])


# label metrics


LM = """ml AS MATERIALIZED (SELECT image_id, label, t, p FROM (""" + " UNION ALL ".join(f"SELECT c.image_id, '{k}' AS label, c.{k} AS t, p.{k} AS p FROM conditions c JOIN pred_conditions p USING (image_id)" for k in LABELS) + """)),
lm AS MATERIALIZED (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM (
  SELECT label, sum(t) AS support, sum(p) AS predicted, sum(t * p) AS tp, CASE WHEN sum(p) > 0 THEN CAST(sum(t * p) AS DOUBLE) / sum(p) ELSE 0 END AS precision, CASE WHEN sum(t) > 0 THEN CAST(sum(t * p) AS DOUBLE) / sum(t) ELSE 0 END AS recall FROM ml GROUP BY label))"""


def lm(v):
    return A.label_metrics(A.confusion_long(v.conditions, v.pred_conditions, LABELS))


@query("l11_multilabel_metrics", """SELECT macro_f2, macro_f1, 5 * p * r / (4 * p + r) AS micro_f2, sample_jaccard, exact_match, 0.50 * macro_f2 + 0.25 * macro_f1 + 0.15 * (5 * p * r / (4 * p + r)) + 0.10 * sample_jaccard AS composite FROM (
  SELECT avg(f2) AS macro_f2, avg(f1) AS macro_f1, CAST(sum(tp) AS DOUBLE) / sum(predicted) AS p, CAST(sum(tp) AS DOUBLE) / sum(support) AS r FROM lm WHERE support >= 30), (SELECT avg(j) AS sample_jaccard, avg(e) AS exact_match FROM (SELECT image_id, CASE WHEN sum(greatest(t, p)) = 0 THEN 1.0 ELSE CAST(sum(t * p) AS DOUBLE) / sum(greatest(t, p)) END AS j, min((t = p)::INT) AS e FROM ml GROUP BY image_id))""",
       ctes=LM, dbl="macro_f2 macro_f1 micro_f2 sample_jaccard exact_match composite")
def _(v):
    return A.multilabel_metrics(v.conditions, v.pred_conditions, LABELS)


@query("l12_route_eligible_labels", "SELECT *, support >= 30 AND f1 >= 0.70 AND recall >= 0.70 AS route_eligible FROM lm", ctes=LM, dbl="precision recall f1 f2", big="support predicted tp")
def _(v):
    return lm(v)


@query("l13_label_family_means", """SELECT CASE WHEN label IN ('no_face', 'single_face', 'multi_face') THEN 'count' WHEN label IN ('low_light_or_dim', 'motion_blur_or_low_sharpness') THEN 'image_quality' ELSE 'other' END AS family, count(*) AS labels, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, avg(f2) AS mean_f2,
  count(*) FILTER (f1 >= 0.7 AND recall >= 0.7) AS route_eligible_labels FROM lm WHERE support >= 30 GROUP BY 1""", ctes=LM, dbl="mean_precision mean_recall mean_f1 mean_f2")
def _(v):
    return A.label_family_means(lm(v), {"count": ["no_face", "single_face", "multi_face"], "image_quality": ["low_light_or_dim", "motion_blur_or_low_sharpness"]})


@query("l04_best_f2_threshold", """SELECT source, arg_min(t, {'v': -round(f2, 12), 'i': i}) AS threshold, max(round(f2, 12)) AS f2 FROM (SELECT source, i, t, CASE WHEN 4 * p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END AS f2 FROM (
  SELECT source, i, t, CASE WHEN count(*) FILTER (score >= t) > 0 THEN CAST(sum(y) FILTER (score >= t) AS DOUBLE) / count(*) FILTER (score >= t) ELSE 0 END AS p, CAST(coalesce(sum(y) FILTER (score >= t), 0) AS DOUBLE) / sum(y) AS r
  FROM (SELECT source, score, (pred_id % 7 < score * 7)::INT AS y FROM cand_boxes) CROSS JOIN (SELECT i, CAST(0.10 AS DOUBLE) + (i - 1) * ((CAST(0.90 AS DOUBLE) - CAST(0.10 AS DOUBLE)) / 32) AS t FROM generate_series(1, 33) AS g(i)) GROUP BY source, i, t)) GROUP BY source""", dbl="threshold f2")
def _(v):
    rows = v.cand_boxes.select("source", C("score").alias("probability"), (C("pred_id") % 7 < C("score") * 7).cast("int").alias("label"))
    return A.best_f2_threshold(rows, ["source"])


@query("l15_gate_confusion", """SELECT label AS condition_label, count(*) AS sample_size, sum(t) AS artifacts, sum(t * p) AS detected, sum(t * (1 - p)) AS missed, sum((1 - t) * p) AS flagged_clean, avg(t * (1 - p)) AS miss_rate, avg(p) AS fallback_rate FROM ml GROUP BY label""",
       ctes=LM, dbl="miss_rate fallback_rate", big="artifacts detected missed flagged_clean")
def _(v):
    rows = A.confusion_long(v.conditions, v.pred_conditions, LABELS).select(C("label").alias("condition_label"), C("t").alias("label"), C("p").alias("prediction"))
    return A.gate_confusion(rows, ["condition_label"])


# embeddings


def gallery(v):
    return v.table("embeddings").select(C("vec_id").alias("id"), C("vec_id").alias("identity"), "embedding")


def protected(v):
    """Stand-in for protected crops: most of the vector is erased."""
    kept = F.transform("embedding", lambda x, i: F.when(i < 48, F.lit(0.0).cast("float")).otherwise(x))
    return v.table("embeddings").select(C("vec_id").alias("id"), C("vec_id").alias("identity"), kept.alias("embedding"))


EMB = """g AS MATERIALIZED (SELECT vec_id AS id, list_transform(e, lambda x: x / n) AS v FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))),
q AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN n = 0 THEN e ELSE list_transform(e, lambda x: x / n) END AS v FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i <= 48 THEN 0.0 ELSE x END) AS e FROM embeddings)))"""
SIMS = EMB + ", best AS MATERIALIZED (SELECT q.id, min({'s': -round(list_inner_product(q.v, g.v), 12), 'b': g.id}) AS b FROM q CROSS JOIN g GROUP BY q.id)"


@query("e01_l2_normalise", "SELECT id, list_sum(list_transform(v, lambda x: x * x)) AS squared, v[1] AS first FROM g", ctes=EMB, dbl="squared first")
def _(v):
    unit = gallery(v).select("id", V.l2_normalise(C("embedding")).alias("u"))
    return unit.select("id", V.dot(C("u"), C("u")).alias("squared"), C("u")[0].alias("first"))


@query("e02_paired_cosine", "SELECT q.id, list_inner_product(q.v, g.v) AS cosine FROM q JOIN g ON q.id = g.id", ctes=EMB, dbl="cosine")
def _(v):
    return V.paired_cosine(gallery(v), protected(v))


@query("e03_reid_rank1", "SELECT id, id AS identity, b.b AS best_id, b.b AS best_identity, -b.s AS similarity, b.b = id AS hit FROM best", ctes=SIMS, dbl="similarity")
def _(v):
    return V.reid_rank1(protected(v), gallery(v))


@query("e03_reid_rate", "SELECT count(*) AS queries, avg((b.b = id)::INT) AS rank1_rate, avg(-b.s) AS mean_similarity FROM best", ctes=SIMS, dbl="rank1_rate mean_similarity")
def _(v):
    return V.reid_rate(V.reid_rank1(protected(v), gallery(v)))


@query("e04_max_similarity", "SELECT id, -b.s AS similarity FROM best", ctes=SIMS, dbl="similarity")
def _(v):
    # no shared identity: the bound comes from the pivots alone
    return V.max_similarity(protected(v).withColumn("identity", -1 - C("identity")), gallery(v))


@query("j17_gallery_join", "SELECT b.b AS best_id, count(*) AS queries FROM best GROUP BY b.b", ctes=SIMS)
def _(v):
    return V.nearest(protected(v), gallery(v)).groupBy("best_id").agg(F.count(F.lit(1)).alias("queries"))


@query("e05_threshold_hits", "SELECT count(*) AS n, avg(c) AS mean_cosine, avg((c >= 0.5)::INT) AS rate_050, avg((c >= 0.6)::INT) AS rate_060, avg((c >= 0.7)::INT) AS rate_070 FROM (SELECT list_inner_product(q.v, g.v) AS c FROM q JOIN g ON q.id = g.id)", ctes=EMB, dbl="mean_cosine rate_050 rate_060 rate_070")
def _(v):
    return V.threshold_hits(V.paired_cosine(gallery(v), protected(v)))


XV = PAIRS + """,
xsim AS MATERIALIZED (SELECT m.method, 1 - (p.egocentric_image_id * 13 + p.exocentric_image_id * 7 + m.method_index * 31) % 997 / 1000.0 AS s, p.* FROM xpairs p JOIN method_metrics m ON m.image_id = p.egocentric_image_id),
ctl AS MATERIALIZED (SELECT egocentric_image_id, exocentric_image_id, s.n.i AS control_exocentric_image_id FROM xpairs p JOIN (SELECT day_id, exocentric_stream_id, timestamp_id, coalesce(lead({'t': timestamp_id, 'i': i}) OVER w, first_value({'t': timestamp_id, 'i': i}) OVER w) AS n
  FROM (SELECT day_id, exocentric_stream_id, timestamp_id, min(exocentric_image_id) AS i FROM xpairs GROUP BY ALL) WINDOW w AS (PARTITION BY day_id, exocentric_stream_id ORDER BY timestamp_id)) s USING (day_id, exocentric_stream_id, timestamp_id) WHERE s.n.t <> p.timestamp_id),
csim AS MATERIALIZED (SELECT m.method, 1 - (p.egocentric_image_id * 13 + p.control_exocentric_image_id * 7 + m.method_index * 31) % 997 / 1000.0 AS s FROM ctl p JOIN method_metrics m ON m.image_id = p.egocentric_image_id)"""


def cross_similarity(v):
    pairs = J.cross_view_pairs(v.manifest)
    methods = v.method_metrics.select(C("image_id").alias("egocentric_image_id"), "method", "method_index")
    methods = unsized(methods)
    score = lambda other: 1 - (C("egocentric_image_id") * 13 + C(other) * 7 + C("method_index") * 31) % 997 / F.lit(1000.0)
    same = pairs.join(methods, "egocentric_image_id").select("method", score("exocentric_image_id").alias("similarity"))
    control = J.control_pairs(pairs).join(methods, "egocentric_image_id").select("method", score("control_exocentric_image_id").alias("similarity"))
    return same, control


@query("e06_crossview_by_method", """SELECT method, pairs, m AS mean_similarity, m - (SELECT avg(s) FROM xsim WHERE method = 'blur') AS delta_vs_original, m - c AS gap_vs_control FROM (SELECT method, count(*) AS pairs, avg(s) AS m FROM xsim GROUP BY method) LEFT JOIN (SELECT method, avg(s) AS c FROM csim GROUP BY method) USING (method)""",
       ctes=XV, dbl="mean_similarity delta_vs_original gap_vs_control")
def _(v):
    return R.crossview_by_method(*cross_similarity(v), original="blur")


@query("e07_verification_metrics", """SELECT method, positive_pairs, negative_pairs, auc, eer, tar_at_far_10, tar_at_far_05, mean_positive, mean_negative, std_positive, std_negative FROM (
  SELECT method, any_value(np) AS positive_pairs, any_value(nq) AS negative_pairs, CAST(sum(q * (tp - p / 2.0)) AS DOUBLE) / (any_value(np) * any_value(nq)) AS auc, arg_min((far + frr) / 2, {'g': round(abs(far - frr), 12), 's': s}) AS eer,
    coalesce(max(CASE WHEN far <= 0.10 THEN 1 - frr END), 0) AS tar_at_far_10, coalesce(max(CASE WHEN far <= 0.05 THEN 1 - frr END), 0) AS tar_at_far_05 FROM (
    SELECT *, CAST(fp AS DOUBLE) / nq AS far, 1 - CAST(tp AS DOUBLE) / np AS frr FROM (SELECT method, s, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY method) AS np, sum(q) OVER (PARTITION BY method) AS nq FROM (
      SELECT method, s, sum(y) AS p, sum(1 - y) AS q FROM allsim GROUP BY method, s) WINDOW w AS (PARTITION BY method ORDER BY s DESC ROWS UNBOUNDED PRECEDING))) GROUP BY method)
JOIN (SELECT method, avg(s) FILTER (y = 1) AS mean_positive, avg(s) FILTER (y = 0) AS mean_negative, stddev_pop(s) FILTER (y = 1) AS std_positive, stddev_pop(s) FILTER (y = 0) AS std_negative FROM allsim GROUP BY method) USING (method)""",
       ctes=XV + ", allsim AS MATERIALIZED (SELECT method, s, 1 AS y FROM xsim UNION ALL SELECT method, s, 0 FROM csim)", dbl="auc eer tar_at_far_10 tar_at_far_05 mean_positive mean_negative std_positive std_negative", big="positive_pairs negative_pairs")
def _(v):
    same, control = cross_similarity(v)
    rows = same.withColumn("positive", F.lit(1)).unionByName(control.withColumn("positive", F.lit(0)))
    return R.verification_metrics(rows)


@query("e08_pair_accounting", """SELECT count(*) AS total_pairs, count(*) FILTER (r IS NULL) AS evaluable_pairs, count(r) AS skipped_pairs, (SELECT string_agg(r || '=' || CAST(n AS VARCHAR), ',' ORDER BY r) FROM (SELECT r, count(*) AS n FROM acc WHERE r IS NOT NULL GROUP BY r)) AS reasons FROM acc""",
       ctes=PAIRS + ", acc AS MATERIALIZED (SELECT CASE WHEN e.box_count = 0 THEN 'no_egocentric_face' WHEN x.box_count = 0 THEN 'no_exocentric_face' END AS r FROM xpairs p JOIN conditions e ON e.image_id = p.egocentric_image_id JOIN conditions x ON x.image_id = p.exocentric_image_id)")
def _(v):
    faces = v.conditions.select("image_id", "box_count")
    side = lambda s: faces.select(C("image_id").alias(f"{s}_image_id"), C("box_count").alias(f"{s}_boxes"))
    rows = J.cross_view_pairs(v.manifest).join(side("egocentric"), "egocentric_image_id").join(side("exocentric"), "exocentric_image_id")
    reason = F.when(C("egocentric_boxes") == 0, "no_egocentric_face").when(C("exocentric_boxes") == 0, "no_exocentric_face")
    out = R.pair_accounting(rows.withColumn("skip_reason", reason))
    return out.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


@query("e09_frechet")
def _(v):
    from frameops.operators.sampling import split_half

    halves = split_half(v.table("embeddings").select("vec_id", "embedding"), "vec_id")
    return V.frechet(halves.filter(C("half") == "reference"), halves.filter(C("half") == "comparison"))


SIM_SQL = """ts AS MATERIALIZED (SELECT doc_id, word, lang, before, CASE WHEN trim(before) = '' AND trim(after) = '' THEN 1.0 WHEN trim(before) = '' OR trim(after) = '' THEN 0.0
  ELSE 1.0 - CAST(length(before) - length(regexp_replace(before, '[aeiou]', '', 'g')) AS DOUBLE) / greatest(length(trim(before)), 1) END AS s FROM text_pairs)"""


@query("e10_suppression_rate", "SELECT lang, count(*) AS regions, avg((s < 0.6)::INT) AS suppression_rate FROM ts GROUP BY lang", ctes=SIM_SQL, dbl="suppression_rate")
def _(v):
    return V.suppression_rate(V.region_similarity(v.text_pairs, "levenshtein"), ("lang",), 0.6)


@query("e11_readability_summary", "SELECT count(*) AS n, avg(s) AS mean, min(s) AS min, max(s) AS max, median(s) AS median FROM ts", ctes=SIM_SQL, dbl="mean min max median")
def _(v):
    return V.readability_summary(V.region_similarity(v.text_pairs, "levenshtein"))


@query("e13_procrustes_error", """SELECT image_id AS id, sqrt(greatest(0.0, 2 - 2 * sqrt(greatest(0.0, (xu * xu + xv * xv + yu * yu + yv * yv + 2 * abs(xu * yv - xv * yu)) / ((xx + yy) * (uu + vv)))))) AS procrustes_error FROM (
  SELECT image_id, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(u) AS uu, var_pop(w) AS vv, covar_pop(x, u) AS xu, covar_pop(x, w) AS xv, covar_pop(y, u) AS yu, covar_pop(y, w) AS yv FROM lmk GROUP BY image_id HAVING count(*) >= 3) WHERE xx + yy > 0 AND uu + vv > 0""",
       ctes="lmk AS MATERIALIZED (SELECT g.image_id, CAST(g.x1 AS DOUBLE) AS x, CAST(g.y1 AS DOUBLE) AS y, CAST(p.x1 AS DOUBLE) AS u, CAST(p.y1 AS DOUBLE) AS w FROM gt_boxes g JOIN pred_boxes p ON p.image_id = g.image_id AND p.pred_id // 3 = g.gt_id)", dbl="procrustes_error")
def _(v):
    # corners of matching boxes as landmarks of a frame
    p = v.pred_boxes.select("image_id", F.floor(C("pred_id") / 3).alias("gt_id"), C("x1").cast("double").alias("bx"), C("y1").cast("double").alias("by"))
    points = v.gt_boxes.join(p, ["image_id", "gt_id"]).select(C("image_id").alias("id"), C("x1").cast("double").alias("ax"), C("y1").cast("double").alias("ay"), "bx", "by")
    enough = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(C("n") >= 3)
    return V.procrustes_error(points.join(enough.select("id"), "id", "left_semi"))


# pixels and text


def pixel_boxes(v):
    k = C("vec_id")
    return v.table("embeddings").select(k.alias("image_id"), F.lit(1).alias("box_id"), (C("label") % 4).cast("bigint").alias("x1"), (C("label") % 3).cast("bigint").alias("y1"), (C("label") % 4 + 4).cast("bigint").alias("x2"),
                                        (C("label") % 3 + 3).cast("bigint").alias("y2"), F.lit(8).alias("width"), F.lit(8).alias("height"))


PB = "pb AS MATERIALIZED (SELECT vec_id AS image_id, label % 4 AS x1, label % 3 AS y1, label % 4 + 4 AS x2, label % 3 + 3 AS y2 FROM embeddings), pin AS MATERIALIZED (SELECT p.*, b.x1, b.y1, p.col >= x1 AND p.col < x2 AND p.row >= y1 AND p.row < y2 AS inside FROM pixels p JOIN pb b USING (image_id))"


@query("r01_raster_quality", """SELECT image_id, avg(v) AS brightness, stddev_pop(v) AS contrast, var_pop(coalesce(l, r) + coalesce(r, l) + coalesce(u, d) + coalesce(d, u) - 4 * v) AS laplacian_variance, avg((v < 110)::INT) AS dark_share, avg((v > 140)::INT) AS bright_share FROM (
  SELECT *, lag(v) OVER a AS l, lead(v) OVER a AS r, lag(v) OVER b AS u, lead(v) OVER b AS d FROM pixels WINDOW a AS (PARTITION BY image_id, row ORDER BY col), b AS (PARTITION BY image_id, col ORDER BY row)) GROUP BY image_id""", dbl="brightness contrast laplacian_variance dark_share bright_share")
def _(v):
    return P.raster_quality(v.pixels, 110, 140)


@query("r02_raster_blockiness", """SELECT image_id, greatest(0.0, avg(d) FILTER (k = 'c' AND i = 4) + avg(d) FILTER (k = 'r' AND i = 4) - avg(d) FILTER (k = 'c' AND i IN (1, 2, 5, 6)) - avg(d) FILTER (k = 'r' AND i IN (1, 2, 5, 6))) AS blockiness, sum(d) FILTER (i = 4) / 4 AS boundary_mean FROM (
  SELECT image_id, k, i, avg(d) AS d FROM (SELECT image_id, 'c' AS k, col AS i, abs(v - lag(v) OVER (PARTITION BY image_id, row ORDER BY col)) AS d FROM pixels UNION ALL SELECT image_id, 'r', row, abs(v - lag(v) OVER (PARTITION BY image_id, col ORDER BY row)) FROM pixels) WHERE d IS NOT NULL GROUP BY ALL) GROUP BY image_id""", dbl="blockiness boundary_mean")
def _(v):
    return P.raster_blockiness(v.pixels, 4)


@query("r03_raster_pixelate", "SELECT image_id, row, col, CASE WHEN inside THEN CAST(floor(avg(v) OVER (PARTITION BY image_id, inside, (col - x1) // 2, (row - y1) // 2)) AS BIGINT) ELSE v END AS v FROM pin", ctes=PB)
def _(v):
    return P.raster_pixelate(v.pixels, pixel_boxes(v), 2)


@query("r04_raster_fill", "SELECT image_id, row, col, CASE WHEN inside THEN 0 ELSE v END AS v FROM pin", ctes=PB)
def _(v):
    return P.raster_fill(v.pixels, pixel_boxes(v))


BLUR = PB + ", soft AS MATERIALIZED (SELECT image_id, row, col, avg(h) OVER (PARTITION BY image_id, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM (SELECT *, avg(v) OVER (PARTITION BY image_id, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM pixels))"


@query("r05_raster_blur", "SELECT p.image_id, p.row, p.col, CASE WHEN inside THEN s ELSE v END AS v FROM pin p JOIN soft USING (image_id, row, col)", ctes=BLUR, dbl="v")
def _(v):
    return P.raster_blur(v.pixels, pixel_boxes(v), 1)


@query("r06_background_preservation", "SELECT image_id, 1 - avg(abs(v - s)) FILTER (NOT inside) / 255 AS background_preservation FROM pin JOIN soft USING (image_id, row, col) GROUP BY image_id", ctes=BLUR, dbl="background_preservation")
def _(v):
    everywhere = v.table("embeddings").select(C("vec_id").alias("image_id"), F.lit(1).alias("box_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(8).alias("x2"), F.lit(8).alias("y2"))
    return P.background_preservation(v.pixels, P.raster_blur(v.pixels, everywhere, 1), pixel_boxes(v))


@query("r07_area_aware_operator", "SELECT image_id, pred_id, CASE WHEN (least(width, x2) - greatest(0, x1)) * (least(height, y2) - greatest(0, y1)) / CAST(width * height AS DOUBLE) <= 0.002 THEN 'fill' ELSE 'blur' END AS operator FROM cand_boxes b JOIN frames f USING (image_id) WHERE least(width, x2) > greatest(0, x1) AND least(height, y2) > greatest(0, y1)")
def _(v):
    rows = v.cand_boxes.join(v.frames.select("image_id", "width", "height"), "image_id")
    return P.area_aware_operator(rows, 0.002).select("image_id", "pred_id", "operator")


@query("r08_redact_regions", """SELECT p.image_id, p.row, p.col, CASE WHEN NOT inside THEN CAST(v AS DOUBLE) WHEN p.image_id % 3 = 0 THEN 0.0 WHEN p.image_id % 3 = 1 THEN s ELSE m END AS v FROM (SELECT *, floor(avg(v) OVER (PARTITION BY image_id, inside, (col - x1) // 2, (row - y1) // 2)) AS m FROM pin) p JOIN soft USING (image_id, row, col)""", ctes=BLUR, dbl="v")
def _(v):
    k = C("image_id") % 3
    return P.redact_regions(v.pixels, pixel_boxes(v).withColumn("operator", F.when(k == 0, "fill").when(k == 1, "blur").otherwise("pixelate")))


@query("r09_redaction_audit", """SELECT lang, count(*) AS regions, avg(s) AS mean_similarity, avg((s < 0.5)::INT) AS suppression_rate, count(*) FILTER (s >= 1.0 AND trim(before) <> '') AS unchanged_regions, count(*) FILTER (trim(before) = '') AS blank_regions,
  count(DISTINCT doc_id) FILTER (s >= 1.0 AND trim(before) <> '') AS documents_with_residual FROM ts GROUP BY lang""", ctes=SIM_SQL, dbl="mean_similarity suppression_rate")
def _(v):
    return V.redaction_audit(V.region_similarity(v.text_pairs, "levenshtein"), "lang", "doc_id")


BATCH = suppress_ctes("cand_boxes", 0.5, "score DESC, pred_id", "pred_id") + """,
fused AS (SELECT image_id, count(DISTINCT source) AS k, max(score) AS score, round_even(round(sum(x2 * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9), 0) - round_even(round(sum(x1 * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9), 0) AS w,
  round_even(round(sum(y2 * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9), 0) - round_even(round(sum(y1 * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9), 0) AS h FROM seeded GROUP BY image_id, seed),
per_frame AS (SELECT image_id, count(*) AS n, max(least(w, h)) AS size FROM fused WHERE least(1.0, CASE WHEN k = 1 THEN score * 0.9 ELSE score + 0.05 * (k - 1) END) >= 0.25 GROUP BY image_id),
route AS (SELECT q.image_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no_action_copy' WHEN size <= 120 OR q.blur_score >= 350 THEN 'blur' ELSE 'pixelate' END AS method FROM quality_frame q LEFT JOIN per_frame p ON p.image_id = q.image_id)"""


@query("r10_profile_batch", """SELECT r.method, count(*) AS frames, avg(CASE WHEN r.method = 'no_action_copy' THEN 1.0 ELSE s.privacy_score END) AS mean_privacy, avg(CASE WHEN r.method = 'no_action_copy' THEN 1.0 ELSE s.utility_score END) AS mean_utility, count(*) FILTER (s.success = 0) AS failures
FROM route r LEFT JOIN scored_metrics s ON s.image_id = r.image_id AND s.method = r.method GROUP BY r.method""", ctes=BATCH, dbl="mean_privacy mean_utility")
def _(v):
    from frameops.plans.flagship import profile_batch

    return profile_batch(v.cand_boxes, v.quality_frame, v.scored_metrics)

