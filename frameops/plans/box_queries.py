"""Queries on boxes: matching, scoring, suppression, fusion and sweeps (B, J06-J09, J12, J16, W02, W07, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.lineage import cut
from frameops.operators import boxes as X
from frameops.operators import matching as M
from frameops.operators import windows as W
from frameops.plans.registry import query
from frameops.plans.sql_greedy import assign_ctes, iou_sql, suppress_ctes
from frameops.plans.views import SOURCES

B01 = assign_ctes("pred_boxes", "gt_boxes", 0.5, "score DESC, pred_id", "pred_id", "gt_id")
B01_MODEL = assign_ctes("cand_boxes", "gt_boxes", 0.5, "score DESC, pred_id", "pred_id", "gt_id", "image_id, source",
                        p="m")
B02 = assign_ctes("gt_boxes", "pred_boxes", 0.5, "gt_id", "gt_id", "pred_id", out="by_gt", p="g")


@query("b01_match_greedy", """
SELECT p.image_id, p.pred_id, m.target AS gt_id, p.score, m.best_iou AS iou,
  m.target IS NOT NULL AS true_positive, m.target IS NULL AS false_positive
FROM pred_boxes p JOIN matched m ON p.image_id = m.image_id AND p.pred_id = m.sid""", ctes=B01, dbl="score iou",
       big="gt_id")
def _(v):
    return M.match_greedy(v.pred_boxes, v.gt_boxes).select(
        "image_id", "pred_id", "gt_id", "score", "iou", "true_positive", "false_positive")


@query("b02_match_gt_order", """
SELECT image_id, sid AS gt_id, target AS pred_id, best_iou AS iou, target IS NOT NULL AS matched FROM by_gt""",
       ctes=B02, dbl="iou", big="pred_id")
def _(v):
    return M.match_gt_order(v.pred_boxes, v.gt_boxes)


def ap_ctes(rows: str, truth: str, keys: str, out: str = "ap_rows") -> str:
    """AP and rates from ``rows`` (keys, image_id, pred_id, score, tp) and ``truth`` (keys, n)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    join = f"LEFT JOIN ap_sum USING ({keys})" if keys else "CROSS JOIN ap_sum"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
ap_run AS (SELECT {k}tp, sum(tp) OVER w AS hits, row_number() OVER w AS seen FROM {rows}
  WINDOW w AS ({part}ORDER BY score DESC, image_id, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap_sum AS (SELECT {k}sum(CASE WHEN tp = 1 THEN CAST(hits AS DOUBLE) / seen END) AS s, sum(tp) AS t, sum(1 - tp) AS f FROM ap_run {group}),
ap_base AS (SELECT {k}n, coalesce(s, 0.0) AS s, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM {truth} {join}),
ap_pr AS (SELECT *, CASE WHEN n > 0 AND t + f > 0 THEN CAST(t AS DOUBLE) / (t + f) ELSE 0.0 END AS precision,
  CASE WHEN n > 0 THEN CAST(t AS DOUBLE) / n ELSE 0.0 END AS recall FROM ap_base),
{out} AS (SELECT {k}CASE WHEN n > 0 THEN s / n ELSE 0.0 END AS ap, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CASE WHEN n > 0 THEN t ELSE 0 END AS true_positives, CASE WHEN n > 0 THEN f ELSE t + f END AS false_positives,
  CASE WHEN n > 0 THEN n - t ELSE 0 END AS false_negatives, n AS ground_truth_boxes FROM ap_pr)"""


RATES = "ap precision recall f1"
COUNTS = "true_positives false_positives false_negatives ground_truth_boxes"
MODEL_ROWS = """
model_rows AS MATERIALIZED (SELECT p.image_id, p.source, p.pred_id, p.score, CASE WHEN m.target IS NULL THEN 0 ELSE 1 END AS tp
  FROM cand_boxes p JOIN matched m ON p.image_id = m.image_id AND p.source = m.source AND p.pred_id = m.sid)"""


@query("b03_average_precision", "SELECT * FROM ap_rows", dbl=RATES, big=COUNTS, ctes=B01_MODEL + "," + MODEL_ROWS + """,
truth AS (SELECT s.source, (SELECT count(*) FROM gt_boxes) AS n FROM (SELECT DISTINCT source FROM cand_boxes) s),"""
       + ap_ctes("model_rows", "truth", "source"))
def _(v):
    matches = M.match_greedy(v.cand_boxes, v.gt_boxes, extra=["source"], keep=["image_id", "source", "pred_id", "score"])
    truth = v.gt_boxes.agg(F.count(F.lit(1)).alias("ground_truth_boxes"))
    return M.average_precision(matches, v.cand_boxes.select("source").distinct().crossJoin(truth), ["source"],
                               at_most=v.cand_boxes.count())


SUBGROUP = B01_MODEL + "," + MODEL_ROWS + """,
sub_rows AS (SELECT r.*, g.subgroup FROM model_rows r JOIN membership g ON r.image_id = g.image_id),
images AS (SELECT subgroup, count(DISTINCT image_id) AS image_count FROM membership GROUP BY subgroup),
truth_n AS (SELECT g.subgroup, count(*) AS n FROM membership g JOIN gt_boxes b ON g.image_id = b.image_id GROUP BY g.subgroup),
flagged AS (SELECT source, subgroup, count(DISTINCT image_id) AS hit_images FROM sub_rows GROUP BY source, subgroup),
truth AS (SELECT s.source, i.subgroup, coalesce(t.n, 0) AS n, i.image_count FROM (SELECT DISTINCT source FROM cand_boxes) s
  CROSS JOIN images i LEFT JOIN truth_n t ON i.subgroup = t.subgroup),""" + ap_ctes("sub_rows", "truth", "source, subgroup") + """,
sub_scores AS MATERIALIZED (SELECT a.*, t.image_count, a.true_positives + a.false_positives AS prediction_boxes,
  CASE WHEN a.ground_truth_boxes = 0 THEN coalesce(f.hit_images, 0) ELSE 0 END AS zero_face_false_positive_images,
  CASE WHEN a.ground_truth_boxes = 0 THEN 1 - CAST(coalesce(f.hit_images, 0) AS DOUBLE) / greatest(1, t.image_count) END AS zero_face_specificity,
  CASE WHEN a.ground_truth_boxes = 0 THEN 1 - CAST(coalesce(f.hit_images, 0) AS DOUBLE) / greatest(1, t.image_count)
    ELSE 0.65 * a.recall + 0.25 * a.f1 + 0.10 * a.precision END AS composite
  FROM ap_rows a JOIN truth t ON a.source = t.source AND a.subgroup = t.subgroup
  LEFT JOIN flagged f ON a.source = f.source AND a.subgroup = f.subgroup)"""


def subgroup_scores(v):
    return M.score_subgroups(v.cand_boxes, v.gt_boxes, v.membership, "source")


@query("b04_score_subgroups", "SELECT * FROM sub_scores", ctes=SUBGROUP, dbl=RATES + " zero_face_specificity composite",
       big=COUNTS + " image_count prediction_boxes zero_face_false_positive_images")
def _(v):
    return subgroup_scores(v)


BEST = """SELECT b.subgroup, b.image_count, b.ground_truth_boxes, b.source AS best_model, b.composite AS best_score,
  s.source AS second_model, s.composite AS second_score, b.composite - s.composite AS margin, b.f1, b.precision, b.recall
FROM (SELECT *, row_number() OVER (PARTITION BY subgroup ORDER BY composite DESC, recall DESC, f1 DESC, precision DESC, source) AS rk FROM sub_scores) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subgroup ORDER BY composite DESC, recall DESC, f1 DESC, precision DESC, source) AS rk FROM sub_scores) s
  ON b.subgroup = s.subgroup AND s.rk = 2 WHERE b.rk = 1"""


@query("w02_best_and_second", BEST, ctes=SUBGROUP, dbl="best_score second_score margin f1 precision recall",
       big="image_count ground_truth_boxes")
def _(v):
    best = W.best_and_second(subgroup_scores(v), ["subgroup"], "source")
    return best.select("subgroup", "image_count", "ground_truth_boxes", F.col("source").alias("best_model"),
                       F.col("composite").alias("best_score"), "second_model", "second_score", "margin", "f1", "precision", "recall")


@query("w10_winners_by_metric", """SELECT subgroup, arg_max(source, {'a': f1, 'b': source}) AS best_by_f1,
  arg_max(source, {'a': recall, 'b': source}) AS best_by_recall, arg_max(source, {'a': composite, 'b': source}) AS best_by_composite
FROM sub_scores GROUP BY subgroup""", ctes=SUBGROUP)
def _(v):
    return W.winners_by_metric(subgroup_scores(v), ["subgroup"], "source", ["f1", "recall", "composite"])


CORRECT = B02 + """,
b02_n AS (SELECT image_id, count(*) AS gt_count, count(target) AS matched_count FROM by_gt GROUP BY image_id),
b02_p AS (SELECT image_id, count(*) AS prediction_count FROM pred_boxes GROUP BY image_id),
correct_a AS (SELECT f.image_id, coalesce(gt_count, 0) AS gt_count, coalesce(matched_count, 0) AS matched_count,
  coalesce(prediction_count, 0) AS prediction_count,
  CASE WHEN coalesce(gt_count, 0) > 0 THEN gt_count = matched_count ELSE coalesce(prediction_count, 0) = 0 END AS correct
  FROM frames f LEFT JOIN b02_n USING (image_id) LEFT JOIN b02_p USING (image_id))"""


@query("b05_image_correct", "SELECT * FROM correct_a", ctes=CORRECT, big="gt_count matched_count prediction_count")
def _(v):
    return M.image_correct(v.pred_boxes, v.gt_boxes, v.frames)


SCRFD = "pred_b AS (SELECT * FROM cand_boxes WHERE source = 'scrfd')"
CORRECT_B = SCRFD + "," + assign_ctes("gt_boxes", "pred_b", 0.5, "gt_id", "gt_id", "pred_id", out="by_gt_b", p="h") + """,
hb_n AS (SELECT image_id, count(*) AS gt_count, count(target) AS matched_count FROM by_gt_b GROUP BY image_id),
hb_p AS (SELECT image_id, count(*) AS prediction_count FROM pred_b GROUP BY image_id),
correct_b AS (SELECT f.image_id, CASE WHEN coalesce(gt_count, 0) > 0 THEN gt_count = matched_count
  ELSE coalesce(prediction_count, 0) = 0 END AS correct
  FROM frames f LEFT JOIN hb_n USING (image_id) LEFT JOIN hb_p USING (image_id))"""


@query("b06_mcnemar", """SELECT *, CASE WHEN only_first + only_second > 0
  THEN CAST((abs(only_first - only_second) - 1) * (abs(only_first - only_second) - 1) AS DOUBLE) / (only_first + only_second) ELSE 0.0 END AS chi_square
FROM (SELECT count(*) FILTER (a.correct AND b.correct) AS both_correct, count(*) FILTER (a.correct AND NOT b.correct) AS only_first,
  count(*) FILTER (NOT a.correct AND b.correct) AS only_second, count(*) FILTER (NOT a.correct AND NOT b.correct) AS both_wrong
  FROM correct_a a JOIN correct_b b USING (image_id))""", ctes=CORRECT + "," + CORRECT_B, dbl="chi_square")
def _(v):
    second = v.cand_boxes.filter(F.col("source") == "scrfd")
    # the p-value has no SQL twin and is checked in tests
    return M.mcnemar(M.image_correct(v.pred_boxes, v.gt_boxes, v.frames),
                     M.image_correct(second, v.gt_boxes, v.frames)).drop("p_value")


DUP = f"""
dup AS MATERIALIZED (SELECT a.image_id, a.pred_id AS first_id, b.pred_id AS second_id, {iou_sql('a', 'b')} AS iou,
  a.score AS first_score, b.score AS second_score FROM pred_boxes a JOIN pred_boxes b ON a.image_id = b.image_id AND a.pred_id < b.pred_id
  WHERE {iou_sql('a', 'b')} >= 0.5)"""


@query("j06_duplicate_pairs", "SELECT * FROM dup", ctes=DUP, dbl="iou first_score second_score")
def _(v):
    return M.duplicate_pairs(v.pred_boxes)


@query("j06_duplicate_counts", "SELECT image_id, count(*) AS pairs FROM dup GROUP BY image_id", ctes=DUP)
def _(v):
    return M.overlap_counts(v.pred_boxes, 0.5)


AUDIT = B01 + "," + DUP + """,
by_pred AS (SELECT image_id, count(*) AS prediction_count, count(target) AS matched_count, count(*) - count(target) AS false_positive_count FROM matched GROUP BY image_id),
by_truth AS (SELECT image_id, count(*) AS gt_count FROM gt_boxes GROUP BY image_id),
by_dup AS (SELECT image_id, count(*) AS duplicate_pair_count FROM dup GROUP BY image_id),
audit AS MATERIALIZED (SELECT f.image_id, f.day_id, f.view_type, f.camera_stream_id, coalesce(gt_count, 0) AS gt_count,
  coalesce(prediction_count, 0) AS prediction_count, coalesce(matched_count, 0) AS matched_count,
  coalesce(false_positive_count, 0) AS false_positive_count, coalesce(duplicate_pair_count, 0) AS duplicate_pair_count,
  coalesce(gt_count, 0) - coalesce(matched_count, 0) AS false_negative_count, coalesce(gt_count, 0) = 0 AS zero_face_image
  FROM frames f LEFT JOIN by_truth USING (image_id) LEFT JOIN by_pred USING (image_id) LEFT JOIN by_dup USING (image_id))"""


def audit(v):
    return M.error_summary(v.pred_boxes, v.gt_boxes, v.frames)


@query("b07_error_audit_images", "SELECT * FROM audit", ctes=AUDIT)
def _(v):
    return audit(v)


@query("b07_false_positives", """SELECT p.image_id, p.pred_id, p.score, m.best_iou AS iou, t.image_id IS NULL AS zero_face
FROM pred_boxes p JOIN matched m ON p.image_id = m.image_id AND p.pred_id = m.sid
LEFT JOIN (SELECT DISTINCT image_id FROM gt_boxes) t ON p.image_id = t.image_id WHERE m.target IS NULL""",
       ctes=B01, dbl="score iou")
def _(v):
    matches = M.match_greedy(v.pred_boxes, v.gt_boxes)
    return M.false_positive_rows(matches, v.gt_boxes).select("image_id", "pred_id", "score", "iou", "zero_face")


@query("b07_false_negatives", """SELECT g.* FROM gt_boxes g WHERE NOT EXISTS (
  SELECT 1 FROM matched m WHERE m.image_id = g.image_id AND m.target = g.gt_id)""", ctes=B01)
def _(v):
    return M.false_negative_rows(M.match_greedy(v.pred_boxes, v.gt_boxes), v.gt_boxes)


@query("b07_counts_by_day_view", """SELECT day_id, view_type, count(*) AS images, sum(false_positive_count) AS false_positives,
  sum(false_negative_count) AS false_negatives FROM audit GROUP BY ALL""", ctes=AUDIT, big="false_positives false_negatives")
def _(v):
    return audit(v).groupBy("day_id", "view_type").agg(
        F.count(F.lit(1)).alias("images"), F.sum("false_positive_count").alias("false_positives"),
        F.sum("false_negative_count").alias("false_negatives"))


@query("w07_top_n_errors", """SELECT image_id, false_positive_count, prediction_count, false_negative_count FROM audit
ORDER BY false_positive_count DESC, prediction_count DESC, image_id LIMIT 25""", ctes=AUDIT)
def _(v):
    order = [F.col("false_positive_count").desc(), F.col("prediction_count").desc(), F.col("image_id")]
    return W.top_n(audit(v), order, 25).select("image_id", "false_positive_count", "prediction_count", "false_negative_count")


@query("b08_missed_audit", """SELECT view_type, count(*) AS face_images, count(*) FILTER (missed > 0) AS images_with_misses,
  sum(faces) AS faces, sum(missed) AS missed_faces, CAST(count(*) FILTER (missed > 0) AS DOUBLE) / count(*) AS image_miss_rate,
  CAST(sum(missed) AS DOUBLE) / sum(faces) AS face_miss_rate
FROM frames JOIN (SELECT image_id, count(*) AS faces, count(*) - count(target) AS missed FROM by_gt GROUP BY image_id) USING (image_id)
GROUP BY view_type""", ctes=B02, dbl="image_miss_rate face_miss_rate", big="faces missed_faces")
def _(v):
    return M.missed_audit(v.pred_boxes, v.gt_boxes, v.frames, "view_type")


@query("b09_slice_eval", "SELECT source, subgroup, precision, recall, f1, ap FROM sub_scores WHERE subgroup <> 'overall'", ctes=SUBGROUP, dbl="precision recall f1 ap")
def _(v):
    return M.slice_eval(v.cand_boxes, v.gt_boxes, v.membership)


NMS = suppress_ctes("cand_boxes", 0.5, "score DESC, pred_id", "pred_id")
CLUSTER = suppress_ctes("cand_boxes", 0.45, "score DESC, pred_id", "pred_id") + """,
clusters AS MATERIALIZED (SELECT image_id, seed AS cluster_id,
  """ + ", ".join(f"CAST(round_even(round(sum({c} * greatest(score, 1e-6)) / sum(greatest(score, 1e-6)), 9), 0) AS BIGINT) AS {c}"
                   for c in ("x1", "y1", "x2", "y2")) + """,
  max(score) AS score, count(*) AS members, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
  count(DISTINCT source) AS source_count,
  coalesce(max(score) FILTER (source = 'rfdetr'), 0.0) AS s0, coalesce(max(score) FILTER (source = 'scrfd'), 0.0) AS s1,
  coalesce(max(score) FILTER (source = 'yolo'), 0.0) AS s2 FROM seeded GROUP BY image_id, seed)"""


@query("b10_nms", "SELECT image_id, pred_id, source, x1, y1, x2, y2, score FROM seeded WHERE seed = pred_id", ctes=NMS, dbl="score")
def _(v):
    return X.nms(v.cand_boxes, 0.5)


@query("b11_cluster_boxes", "SELECT image_id, cluster_id, x1, y1, x2, y2, score, members, sources, s0 AS rfdetr, s1 AS scrfd, s2 AS yolo FROM clusters",
       ctes=CLUSTER, dbl="score rfdetr scrfd yolo")
def _(v):
    out = X.cluster_boxes(v.cand_boxes, 0.45)
    scores = [F.coalesce(F.try_element_at("source_scores", F.lit(s)), F.lit(0.0)).alias(s) for s in SOURCES]
    return out.select("image_id", "cluster_id", "x1", "y1", "x2", "y2", "score", "members",
                      F.array_join("sources", "|").alias("sources"), *scores)


@query("b12_fuse", """SELECT image_id, cluster_id, x1, y1, x2, y2, fused AS score, source_count FROM (
  SELECT *, least(1.0, CASE WHEN source_count = 1 THEN (score + 0.05 * (source_count - 1)) * 0.9 ELSE score + 0.05 * (source_count - 1) END) AS fused FROM clusters)
WHERE fused >= 0.25""", ctes=CLUSTER.replace("0.45", "0.5"), dbl="score")
def _(v):
    return X.fuse(v.cand_boxes, 0.5).select("image_id", "cluster_id", "x1", "y1", "x2", "y2", "score", "source_count")


@query("b13_union_scored", "SELECT image_id, pred_id, score FROM seeded WHERE seed = pred_id",
       ctes="two AS (SELECT * FROM cand_boxes WHERE source IN ('scrfd', 'yolo'))," +
       suppress_ctes("two", 0.5, "score DESC, pred_id", "pred_id"), dbl="score")
def _(v):
    parts = [v.cand_boxes.filter(F.col("source") == s) for s in ("scrfd", "yolo")]
    return X.union_scored(parts).select("image_id", "pred_id", "score")


def merge_ctes(trigger: str) -> str:
    """``trigger``: a SELECT of image_id; ends in ``merged``."""
    return f"""
trig AS (SELECT DISTINCT image_id FROM ({trigger})),
merge_in AS (SELECT image_id, pred_id, x1, y1, x2, y2, score, CAST(0 AS BIGINT) AS stage FROM pred_boxes
  UNION ALL SELECT image_id, pred_id, x1, y1, x2, y2, score, CAST(1 AS BIGINT) FROM cand_boxes
  WHERE source = 'scrfd' AND image_id IN (SELECT image_id FROM trig)),""" + suppress_ctes(
        "merge_in", 0.5, "stage, pred_id", "pred_id", out="merge_seed", fixed="stage = 0", p="f") + """,
merged AS MATERIALIZED (SELECT image_id, pred_id, x1, y1, x2, y2, CASE WHEN stage = 1 THEN score * 0.95 ELSE score END AS score,
  stage = 1 AS from_fallback FROM merge_seed WHERE seed = pred_id)"""


def two_detectors(v):
    return v.pred_boxes, v.cand_boxes.filter(F.col("source") == "scrfd")


@query("b14_fallback_merge", "SELECT * FROM merged", ctes=merge_ctes("SELECT image_id FROM conditions WHERE multi_face = 1"), dbl="score")
def _(v):
    return X.fallback_merge(*two_detectors(v), v.conditions.filter("multi_face = 1"))


FEW = """SELECT i.image_id FROM (SELECT image_id FROM pred_boxes UNION SELECT image_id FROM cand_boxes WHERE source = 'scrfd') i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM pred_boxes GROUP BY image_id) c USING (image_id) WHERE coalesce(n, 0) <= 2"""


@query("b15_fallback_by_count", "SELECT * FROM merged", ctes=merge_ctes(FEW), dbl="score")
def _(v):
    return X.fallback_by_count(*two_detectors(v), 2)


SIGNALS = """
sig_raw AS (SELECT image_id, min(least(x2 - x1, y2 - y1)) AS min_face,
  arg_max((y1 + y2) / 2.0, {'a': (x2 - x1) * (y2 - y1), 'o': -pred_id}) AS cy FROM pred_boxes GROUP BY image_id),
sig AS MATERIALIZED (SELECT f.image_id, CAST(coalesce(min_face, 0) AS DOUBLE) AS min_detected_face_size_px,
  coalesce(cy / greatest(f.height, 1), 0.0) AS dominant_center_y_ratio, q.text_score
  FROM frames f JOIN quality_frame q ON f.image_id = q.image_id LEFT JOIN sig_raw s ON f.image_id = s.image_id),
signals AS MATERIALIZED (SELECT *, min_detected_face_size_px > 0 AND min_detected_face_size_px <= 80 AS small_face_like,
  dominant_center_y_ratio >= 0.62 AS downward_like, text_score >= 30 AS text_like FROM sig)"""


def signal_frames(v):
    return v.frames.select("image_id", "height").join(v.quality_frame.select("image_id", "text_score"), "image_id")


@query("b16_fallback_signals", "SELECT *, small_face_like OR downward_like OR text_like AS fallback_triggered FROM signals",
       ctes=SIGNALS, dbl="min_detected_face_size_px dominant_center_y_ratio text_score")
def _(v):
    return X.trigger_signals(v.pred_boxes, signal_frames(v))


@query("b16_fallback_by_signal", "SELECT * FROM merged", dbl="score",
       ctes=SIGNALS + "," + merge_ctes("SELECT image_id FROM signals WHERE small_face_like OR downward_like OR text_like"))
def _(v):
    return X.fallback_by_signal(*two_detectors(v), signal_frames(v))


def grid_ctes(grid: str, triggered: str, images: str = "frames") -> str:
    """Scores per grid point; ``grid``: SELECT grid_id ..., ``triggered``: SELECT grid_id, image_id."""
    everything = merge_ctes("SELECT image_id FROM frames")
    complete = "".join(
        assign_ctes("gt_boxes", boxes, 0.5, "gt_id", "gt_id", "pred_id", out=f"{name}_gt", p=p) + f""",
{name} AS MATERIALIZED (SELECT image_id, bool_and(target IS NOT NULL) AS ok FROM {name}_gt GROUP BY image_id),"""
        for boxes, name, p in (("pred_boxes", "before", "bef_"), ("merged", "after", "aft_")))
    return everything + f""",
grid AS ({grid}), trig_g AS MATERIALIZED ({triggered}),
b_in AS (SELECT image_id, 'base' AS variant, pred_id, x1, y1, x2, y2, score FROM pred_boxes
  UNION ALL SELECT image_id, 'merged', pred_id, x1, y1, x2, y2, score FROM merged),""" + assign_ctes(
        "b_in", "gt_boxes", 0.5, "score DESC, pred_id", "pred_id", "gt_id", "image_id, variant", out="b_match", p="v") + """,
b_rows AS MATERIALIZED (SELECT b.image_id, b.variant, b.pred_id, b.score, CASE WHEN m.target IS NULL THEN 0 ELSE 1 END AS tp
  FROM b_in b JOIN b_match m ON b.image_id = m.image_id AND b.variant = m.variant AND b.pred_id = m.sid),
g_rows AS MATERIALIZED (SELECT g.grid_id, r.* FROM grid g CROSS JOIN b_rows r LEFT JOIN trig_g t ON t.grid_id = g.grid_id AND t.image_id = r.image_id
  WHERE (t.image_id IS NOT NULL) = (r.variant = 'merged')),
g_truth AS (SELECT grid_id, (SELECT count(*) FROM gt_boxes) AS n FROM grid),""" + complete + f"""
g_images AS (SELECT g.grid_id, count(*) FILTER (CASE WHEN t.image_id IS NULL THEN b.ok ELSE a.ok END) AS images_fully_correct,
  count(*) FILTER (NOT CASE WHEN t.image_id IS NULL THEN b.ok ELSE a.ok END) AS images_with_missed_faces,
  count(*) FILTER (CASE WHEN t.image_id IS NULL THEN b.ok ELSE a.ok END) / (SELECT count(DISTINCT image_id) FROM {images}) AS image_level_full_match_rate
  FROM grid g CROSS JOIN before b JOIN after a ON a.image_id = b.image_id LEFT JOIN trig_g t ON t.grid_id = g.grid_id AND t.image_id = b.image_id
  GROUP BY g.grid_id),
g_fired AS (SELECT grid_id, count(*) AS c FROM trig_g GROUP BY grid_id),""" + ap_ctes("g_rows", "g_truth", "grid_id", "g_points") + """,
g_scores AS MATERIALIZED (SELECT p.*, coalesce(f.c, 0) AS triggered_images, m.* EXCLUDE (grid_id) FROM g_points p JOIN g_images m USING (grid_id) LEFT JOIN g_fired f USING (grid_id))"""


LABELS_USED = ("large_face", "low_light_or_dim", "motion_blur_or_low_sharpness", "multi_face", "single_face")
COND = f"""cond AS MATERIALIZED (SELECT image_id, CASE {' '.join(f"WHEN {k} = 1 THEN '{k}'" for k in LABELS_USED)} ELSE 'other' END AS condition_label FROM conditions)"""
SUBSETS = f"""subsets AS MATERIALIZED (SELECT g.grid_id, l.label FROM generate_series(1, {2 ** len(LABELS_USED) - 1}) AS g(grid_id)
  JOIN (SELECT unnest(range({len(LABELS_USED)})) AS bit, unnest({list(LABELS_USED)}) AS label) l ON (g.grid_id >> l.bit) & 1 = 1)"""
IMAGE_LEVEL = " triggered_images images_fully_correct images_with_missed_faces"
BY_LABEL = COND + "," + SUBSETS + "," + grid_ctes(
    "SELECT DISTINCT grid_id FROM subsets", "SELECT s.grid_id, c.image_id FROM cond c JOIN subsets s ON c.condition_label = s.label", "conditions") + """,
by_label AS MATERIALIZED (SELECT s.*, n.trigger_labels FROM g_scores s
  JOIN (SELECT grid_id, string_agg(label, '|' ORDER BY label) AS trigger_labels FROM subsets GROUP BY grid_id) n USING (grid_id))"""


def label_sweep(v):
    label = F.coalesce(*[F.when(F.col(k) == 1, F.lit(k)) for k in LABELS_USED], F.lit("other"))
    cond = v.conditions.select("image_id", label.alias("condition_label"))
    return X.fallback_by_label(*two_detectors(v), v.gt_boxes, cond, LABELS_USED)


@query("b17_fallback_by_label", "SELECT * FROM by_label", ctes=BY_LABEL, dbl=RATES + " image_level_full_match_rate", big=COUNTS + " grid_id" + IMAGE_LEVEL)
def _(v):
    return label_sweep(v)


@query("b17_best_policy", """SELECT grid_id, trigger_labels, triggered_images FROM by_label
ORDER BY round(recall, 6) DESC, round(f1, 6) DESC, false_positives, triggered_images, grid_id LIMIT 1""", ctes=BY_LABEL, big="grid_id triggered_images")
def _(v):
    return X.best_label_policy(label_sweep(v)).select("grid_id", "trigger_labels", "triggered_images")


@query("b17_recommended_policy", """SELECT grid_id, trigger_labels, triggered_images FROM by_label
WHERE round(round(recall, 6), 9) >= round((SELECT max(round(recall, 6)) FROM by_label) - 0.005, 9)
ORDER BY round(f1, 6) DESC, round(precision, 6) DESC, false_positives, triggered_images, grid_id LIMIT 1""", ctes=BY_LABEL, big="grid_id triggered_images")
def _(v):
    return X.recommended_label_policy(label_sweep(v)).select("grid_id", "trigger_labels", "triggered_images")


EDGE = "(x1 <= margin OR y1 <= margin OR x2 >= 3840 - margin OR y2 >= 2160 - margin)"
POST_GRID = f"""post_grid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY margin, side, top) - 1 AS grid_id, margin, side, top
  FROM (SELECT unnest({list(X.MARGINS)}) AS margin) CROSS JOIN (SELECT unnest({list(X.SIDES)}) AS side)
  CROSS JOIN (SELECT CAST(unnest({list(X.TOP_SCORES)}) AS DOUBLE) AS top))"""
GONE = POST_GRID + f""",
gone AS MATERIALIZED (SELECT g.grid_id, p.image_id, p.pred_id FROM pred_boxes p JOIN post_grid g
  ON {EDGE} AND least(x2 - x1, y2 - y1) >= side AND score <= top)"""
POST = GONE + """,
lost AS MATERIALIZED (SELECT grid_id, image_id, string_agg(pred_id, ',' ORDER BY pred_id) AS variant FROM gone GROUP BY grid_id, image_id),
lost_first AS (SELECT image_id, variant, min(grid_id) AS grid_id FROM lost GROUP BY image_id, variant),
post_in AS MATERIALIZED (SELECT p.image_id, '' AS variant, p.pred_id, p.x1, p.y1, p.x2, p.y2, p.score FROM pred_boxes p
  UNION ALL SELECT p.image_id, l.variant, p.pred_id, p.x1, p.y1, p.x2, p.y2, p.score FROM pred_boxes p JOIN lost_first l ON p.image_id = l.image_id
  WHERE (l.grid_id, p.image_id, p.pred_id) NOT IN (SELECT grid_id, image_id, pred_id FROM gone)),""" + assign_ctes(
    "post_in", "gt_boxes", 0.5, "score DESC, pred_id", "pred_id", "gt_id", "image_id, variant", out="post_match", p="v") + """,
post_tp AS MATERIALIZED (SELECT p.image_id, p.variant, p.pred_id, p.score, CASE WHEN m.target IS NULL THEN 0 ELSE 1 END AS tp
  FROM post_in p JOIN post_match m ON p.image_id = m.image_id AND p.variant = m.variant AND p.pred_id = m.sid),
post_points AS (SELECT grid_id FROM post_grid UNION ALL SELECT -1),
post_rows AS MATERIALIZED (SELECT g.grid_id, r.image_id, r.pred_id, r.score, r.tp FROM post_points g CROSS JOIN post_tp r
  LEFT JOIN lost l ON l.grid_id = g.grid_id AND l.image_id = r.image_id WHERE r.variant = coalesce(l.variant, '')),
post_truth AS (SELECT grid_id, (SELECT count(*) FROM gt_boxes) AS n FROM post_points),""" + ap_ctes("post_rows", "post_truth", "grid_id", "post_scores") + """,
post AS MATERIALIZED (SELECT s.*, g.margin AS edge_margin_px, g.side AS large_min_side_px, g.top AS max_score,
  (SELECT count(*) FROM gone a WHERE a.grid_id = s.grid_id) AS removed_count,
  s.ap - b.ap AS delta_ap, s.precision - b.precision AS delta_precision, s.recall - b.recall AS delta_recall, s.f1 - b.f1 AS delta_f1,
  s.false_positives - b.false_positives AS delta_false_positives, s.false_negatives - b.false_negatives AS delta_false_negatives,
  s.recall - b.recall >= -0.003 AND s.false_positives < b.false_positives AS viable
  FROM post_scores s JOIN post_grid g ON s.grid_id = g.grid_id JOIN post_scores b ON b.grid_id = -1)"""
DELTAS = "delta_ap delta_precision delta_recall delta_f1"


def post_sweep(v):
    return X.sweep_postfilter(v.pred_boxes, v.gt_boxes)


@query("b18_sweep_postfilter", "SELECT * FROM post", ctes=POST, dbl=RATES + " max_score " + DELTAS,
       big=COUNTS + " grid_id edge_margin_px large_min_side_px removed_count delta_false_positives delta_false_negatives")
def _(v):
    return post_sweep(v)


@query("b18_best_postfilter", "SELECT grid_id, ap, f1, false_positives FROM post WHERE viable ORDER BY round(ap, 9) DESC, round(f1, 9) DESC, false_positives, grid_id LIMIT 1",
       ctes=POST, dbl="ap f1", big="grid_id false_positives")
def _(v):
    return X.best_postfilter(post_sweep(v)).select("grid_id", "ap", "f1", "false_positives")


FB_GRID = f"""SELECT row_number() OVER (ORDER BY size_threshold, center_y_threshold, text_threshold) - 1 AS grid_id, *
  FROM (SELECT CAST(unnest({list(X.SIZE_THRESHOLDS)}) AS DOUBLE) AS size_threshold) CROSS JOIN (SELECT CAST(unnest({list(X.CENTER_THRESHOLDS)}) AS DOUBLE) AS center_y_threshold)
  CROSS JOIN (SELECT CAST(unnest({list(X.TEXT_THRESHOLDS)}) AS DOUBLE) AS text_threshold)"""
FB = SIGNALS + "," + f"""fb_grid AS MATERIALIZED ({FB_GRID}),
fired AS MATERIALIZED (SELECT g.grid_id, s.image_id, min_detected_face_size_px > 0 AND min_detected_face_size_px <= size_threshold AS a,
  dominant_center_y_ratio >= center_y_threshold AS b, text_score >= text_threshold AS c FROM sig s CROSS JOIN fb_grid g),
fb_n AS (SELECT grid_id, count(*) FILTER (a) AS small_face_like_images,
  count(*) FILTER (b) AS downward_like_images, count(*) FILTER (c) AS text_like_images FROM fired GROUP BY grid_id),""" + grid_ctes(
    "SELECT grid_id FROM fb_grid", "SELECT grid_id, image_id FROM fired WHERE a OR b OR c") + """,
fb_sweep AS (SELECT g.*, s.* EXCLUDE (grid_id), n.* EXCLUDE (grid_id) FROM fb_grid g JOIN g_scores s USING (grid_id) JOIN fb_n n USING (grid_id))"""


def fallback_sweep(v):
    return X.sweep_fallback(*two_detectors(v), v.gt_boxes, signal_frames(v))


@query("b19_sweep_fallback", "SELECT * FROM fb_sweep", ctes=FB, dbl=RATES + " size_threshold center_y_threshold text_threshold image_level_full_match_rate",
       big=COUNTS + " grid_id" + IMAGE_LEVEL)
def _(v):
    return fallback_sweep(v)


@query("b19_best_fallback", """SELECT grid_id, triggered_images FROM fb_sweep ORDER BY round(f1, 6) DESC, round(recall, 6) DESC, false_positives,
  triggered_images, grid_id LIMIT 1""", ctes=FB, big="grid_id")
def _(v):
    return X.best_fallback(fallback_sweep(v)).select("grid_id", "triggered_images")


COUNT_GRID = """pn AS (SELECT f.image_id, coalesce(n, 0) AS n FROM frames f LEFT JOIN (SELECT image_id, count(*) AS n FROM pred_boxes GROUP BY image_id) USING (image_id)),
kgrid AS (SELECT CAST(unnest([0, 1, 2, 3, 4, 5]) AS BIGINT) AS grid_id),""" + grid_ctes(
    "SELECT grid_id FROM kgrid", "SELECT k.grid_id, pn.image_id FROM pn JOIN kgrid k ON pn.n <= k.grid_id")


def count_sweep(v):
    return X.sweep_count_threshold(*two_detectors(v), v.gt_boxes, v.frames)


@query("b20_sweep_count_threshold", "SELECT * FROM g_scores", ctes=COUNT_GRID, dbl=RATES + " image_level_full_match_rate", big=COUNTS + IMAGE_LEVEL)
def _(v):
    return count_sweep(v)


@query("b21_recommend_within", """SELECT grid_id, recall, f1 FROM g_scores WHERE recall >= (SELECT max(recall) FROM g_scores) - 0.01
ORDER BY round(f1, 9) DESC, round(precision, 9) DESC, false_positives, grid_id LIMIT 1""", ctes=COUNT_GRID, dbl="recall f1")
def _(v):
    order = [F.col("f1"), F.col("precision"), -F.col("false_positives"), -F.col("grid_id")]
    return X.recommend_within(count_sweep(v), 0.01, order).select("grid_id", "recall", "f1")


RULES = ((("no_face",), "scrfd"), (("large_face", "low_light_or_dim"), "yolo"),
         (("motion_blur_or_low_sharpness", "single_face"), "rfdetr"), (("medium_face", "profile_or_occluded_face"), "scrfd"))


@query("b22_category_source", """SELECT b.image_id, b.pred_id, b.source, b.score FROM cand_boxes b JOIN (
  SELECT image_id, CASE WHEN no_face = 1 THEN 'scrfd' WHEN large_face = 1 OR low_light_or_dim = 1 THEN 'yolo'
  WHEN motion_blur_or_low_sharpness = 1 OR single_face = 1 THEN 'rfdetr' WHEN medium_face = 1 OR profile_or_occluded_face = 1 THEN 'scrfd'
  ELSE 'yolo' END AS source FROM pred_conditions) s ON b.image_id = s.image_id AND b.source = s.source""", dbl="score")
def _(v):
    chosen = X.category_source(v.pred_conditions, RULES, "yolo")
    return X.select_by_source(v.cand_boxes, chosen).select("image_id", "pred_id", "source", "score")


FEATURES = CLUSTER + """,
feats AS MATERIALIZED (SELECT c.image_id, c.cluster_id, c.score, CAST(source_count AS DOUBLE) AS source_count,
  greatest(0.0, (x2 - x1) / CAST(width AS DOUBLE)) AS width_ratio, greatest(0.0, (y2 - y1) / CAST(height AS DOUBLE)) AS height_ratio,
  ((x1 + x2) / 2.0) / width AS center_x, ((y1 + y2) / 2.0) / height AS center_y,
  least(CAST(x1 AS DOUBLE) / width, CAST(y1 AS DOUBLE) / height, CAST(width - x2 AS DOUBLE) / width, CAST(height - y2 AS DOUBLE) / height) AS edge_distance,
  greatest(s0, s1, s2) AS source_max, (s0 + s1 + s2) / 3 AS source_mean, greatest(s0, s1, s2) - least(s0, s1, s2) AS source_range,
  sqrt(((s0 - (s0 + s1 + s2) / 3) ** 2 + (s1 - (s0 + s1 + s2) / 3) ** 2 + (s2 - (s0 + s1 + s2) / 3) ** 2) / 3) AS source_std,
  CAST((s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT AS DOUBLE) AS source_positive, s0 AS score_rfdetr, s1 AS score_scrfd, s2 AS score_yolo
  FROM clusters c JOIN frames f ON c.image_id = f.image_id)"""
FEATURE_COLS = ("score source_count width_ratio height_ratio center_x center_y edge_distance source_max source_mean source_range "
                "source_std source_positive score_rfdetr score_scrfd score_yolo area_ratio aspect")


@query("b23_cluster_features", "SELECT *, width_ratio * height_ratio AS area_ratio, height_ratio / greatest(width_ratio, 1e-9) AS aspect FROM feats",
       ctes=FEATURES, dbl=FEATURE_COLS)
def _(v):
    out = X.cluster_features(X.cluster_boxes(v.cand_boxes, 0.45), v.frames, SOURCES)
    return out.select("image_id", "cluster_id", *FEATURE_COLS.split())


@query("b24_cluster_keep_default", """SELECT image_id, cluster_id, least(1.0, kept) AS score FROM (
  SELECT *, CASE WHEN source_count = 1 THEN score * 0.88 ELSE score END AS kept FROM clusters) WHERE kept >= 0.25""", ctes=CLUSTER, dbl="score")
def _(v):
    return X.keep_default(X.cluster_boxes(v.cand_boxes, 0.45)).select("image_id", "cluster_id", "score")


LINK = """
lk AS MATERIALIZED (SELECT c.image_id, c.pred_id, c.x1, c.y1, c.x2, c.y2, (c.x1 + c.x2) / 2.0 AS cx, (c.y1 + c.y2) / 2.0 AS cy, f.width, f.height,
  0.09 * greatest(f.width, f.height) AS link FROM cand_boxes c JOIN frames f ON c.image_id = f.image_id
  WHERE c.image_id IN (SELECT image_id FROM cand_boxes GROUP BY image_id HAVING count(*) >= 5)),
link_edges AS MATERIALIZED (SELECT a.image_id, a.pred_id AS a, b.pred_id AS b FROM lk a JOIN lk b ON a.image_id = b.image_id
  AND abs(a.cx - b.cx) <= a.link AND abs(a.cy - b.cy) <= a.link),
rec_reach AS (SELECT image_id, pred_id AS a, pred_id AS b FROM lk UNION SELECT r.image_id, r.a, e.b FROM rec_reach r JOIN link_edges e ON r.image_id = e.image_id AND r.b = e.a),
comp AS (SELECT image_id, a AS pred_id, min(b) AS component FROM rec_reach GROUP BY image_id, a),
hyp AS (SELECT lk.image_id, component, any_value(width) AS width, any_value(height) AS height, count(*) AS members, min(x1) AS lx, min(y1) AS ly, max(x2) AS hx, max(y2) AS hy
  FROM lk JOIN comp ON lk.image_id = comp.image_id AND lk.pred_id = comp.pred_id GROUP BY lk.image_id, component HAVING count(*) >= 5),
hyp_box AS MATERIALIZED (SELECT image_id, members, greatest(0, lx - CAST(floor((hx - lx) * 0.18) AS BIGINT)) AS x1, greatest(0, ly - CAST(floor((hy - ly) * 0.18) AS BIGINT)) AS y1,
  least(width, hx + CAST(floor((hx - lx) * 0.18) AS BIGINT)) AS x2, least(height, hy + CAST(floor((hy - ly) * 0.18) AS BIGINT)) AS y2, width * height AS fa FROM hyp),
hyps AS MATERIALIZED (SELECT image_id, members, x1, y1, x2, y2, 0.35 AS score FROM hyp_box
  WHERE CAST(greatest(0, x2 - x1) * greatest(0, y2 - y1) AS DOUBLE) / fa BETWEEN 0.006 AND 0.45)"""


@query("b25_link_components", "SELECT * FROM hyps UNION ALL SELECT * FROM hyps WHERE FALSE", ctes=LINK, dbl="score")
def _(v):
    return X.link_components(v.cand_boxes, v.frames)


@query("b26_screen_cascade", """SELECT image_id, x1, y1, x2, y2, score, screen_source FROM (
  SELECT *, min(priority) OVER (PARTITION BY image_id) AS first FROM (
    SELECT image_id, x1, y1, x2, y2, score, 0 AS priority, 'detector' AS screen_source FROM pred_boxes
    UNION ALL SELECT image_id, x1, y1, x2, y2, score, 1, 'text_cluster' FROM hyps
    UNION ALL SELECT image_id, x1, y1, x2, y2, score, 2, 'edge' FROM cand_boxes WHERE source = 'yolo')) WHERE priority = first""",
       ctes=LINK, dbl="score")
def _(v):
    # small, and read twice
    hyps = cut(X.link_components(v.cand_boxes, v.frames))
    edge = v.cand_boxes.filter(F.col("source") == "yolo")
    return X.screen_cascade([("detector", v.pred_boxes), ("text_cluster", hyps), ("edge", edge)])


@query("b27_dominant_box", """SELECT image_id, b.gt_id AS gt_id, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2,
  sqrt(greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1))) AS face_size_px FROM (
  SELECT image_id, arg_max({'gt_id': gt_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, {'a': (x2 - x1) * (y2 - y1), 'o': -gt_id}) AS b FROM (
    SELECT g.image_id, gt_id, greatest(0, least(x1, width)) AS x1, greatest(0, least(y1, height)) AS y1,
      greatest(greatest(0, least(x1, width)) + 1, least(x2, width)) AS x2, greatest(greatest(0, least(y1, height)) + 1, least(y2, height)) AS y2
    FROM gt_boxes g JOIN frames f ON g.image_id = f.image_id) GROUP BY image_id)""", dbl="face_size_px")
def _(v):
    return X.dominant_box(v.gt_boxes, v.frames)


@query("b28_presence_confusion", """SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,
  2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (
  SELECT count(*) AS image_count, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn,
    count(*) FILTER (NOT p AND NOT g) AS tn FROM (SELECT image_id IN (SELECT image_id FROM pred_boxes) AS p, image_id IN (SELECT image_id FROM gt_boxes) AS g FROM frames))""",
       dbl="precision recall f1")
def _(v):
    return X.presence_confusion(v.pred_boxes, v.gt_boxes, v.frames)


@query("b29_coverage_purity", """SELECT (SELECT avg(least(1.0, coalesce(s, 0) / CAST((x2 - x1) * (y2 - y1) AS DOUBLE))) FROM gt_boxes g LEFT JOIN
    (SELECT image_id, gt_id, sum(i) AS s FROM ov GROUP BY ALL) o ON g.image_id = o.image_id AND g.gt_id = o.gt_id) AS mean_ground_truth_area_coverage,
  (SELECT avg(least(1.0, coalesce(s, 0) / CAST((x2 - x1) * (y2 - y1) AS DOUBLE))) FROM pred_boxes g LEFT JOIN
    (SELECT image_id, pred_id, sum(i) AS s FROM ov GROUP BY ALL) o ON g.image_id = o.image_id AND g.pred_id = o.pred_id) AS mean_prediction_purity""",
       ctes="""ov AS MATERIALIZED (SELECT p.image_id, p.pred_id, g.gt_id, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS i
  FROM pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id)""", dbl="mean_ground_truth_area_coverage mean_prediction_purity")
def _(v):
    return X.coverage_purity(v.pred_boxes, v.gt_boxes)


TEXT_VARIANTS = (("unfiltered", 0.0, 1e9, 999), ("min10k_top3", 10000.0, 1.05, 3), ("min20k_top1", 20000.0, 1.1, 1))
TEXT = """tv AS (SELECT * FROM (VALUES ('unfiltered', 0.0, 1e9, 999), ('min10k_top3', 10000.0, 1.05, 3), ('min20k_top1', 20000.0, 1.1, 1)) AS t(name, min_area, max_aspect, max_n)),
tx_all AS (SELECT p.*, tv.name, tv.max_n, row_number() OVER (PARTITION BY tv.name, p.image_id ORDER BY score DESC, pred_id) AS rk FROM pred_boxes p CROSS JOIN tv
  WHERE CAST((x2 - x1) * (y2 - y1) AS DOUBLE) >= min_area AND CAST(greatest(x2 - x1, y2 - y1) AS DOUBLE) / greatest(least(x2 - x1, y2 - y1), 1) <= max_aspect),
tx_in AS MATERIALIZED (SELECT * FROM tx_all WHERE rk <= max_n),""" + assign_ctes(
    "tx_in", "gt_boxes", 0.5, "score DESC, pred_id", "pred_id", "gt_id", "image_id, name", out="tx_match", p="t") + """,
sp AS MATERIALIZED (SELECT image_id, CASE WHEN view_type = 'egocentric' THEN 'development' ELSE 'test' END AS split FROM frames)"""


@query("b30_text_filter_sweep", """SELECT *, CASE WHEN true_positives + false_positives > 0 THEN CAST(true_positives AS DOUBLE) / (true_positives + false_positives) ELSE 0.0 END AS precision,
  CAST(true_positives AS DOUBLE) / ground_truth_boxes AS recall, ground_truth_boxes - true_positives AS false_negatives,
  2.0 * true_positives / (true_positives + false_positives + ground_truth_boxes) AS f1
FROM (SELECT name, split, count(target) AS true_positives, count(*) - count(target) AS false_positives FROM tx_match JOIN sp USING (image_id) GROUP BY name, split)
JOIN (SELECT split, count(*) AS ground_truth_boxes FROM gt_boxes JOIN sp USING (image_id) GROUP BY split) USING (split)""",
       ctes=TEXT, dbl="precision recall f1")
def _(v):
    split = F.when(F.col("view_type") == "egocentric", "development").otherwise("test").alias("split")
    return X.text_filter_sweep(v.pred_boxes, v.gt_boxes, v.frames.select("image_id", split), TEXT_VARIANTS)


@query("j07_text_outside_screens", """SELECT t.image_id, t.pred_id FROM cand_boxes t WHERE t.source = 'scrfd' AND NOT EXISTS (
  SELECT 1 FROM cand_boxes s WHERE s.source = 'yolo' AND s.image_id = t.image_id AND (
    ((t.x1 BETWEEN s.x1 AND s.x2) OR (t.x2 BETWEEN s.x1 AND s.x2)) AND ((t.y1 BETWEEN s.y1 AND s.y2) OR (t.y2 BETWEEN s.y1 AND s.y2))
    OR ((t.x1 + t.x2) / 2.0 BETWEEN s.x1 AND s.x2 AND (t.y1 + t.y2) / 2.0 BETWEEN s.y1 AND s.y2)))""")
def _(v):
    texts, screens = (v.cand_boxes.filter(F.col("source") == s) for s in ("scrfd", "yolo"))
    return X.text_outside_screens(texts, screens).select("image_id", "pred_id")


@query("j08_cluster_truth_label", f"""SELECT c.image_id, c.cluster_id, CASE WHEN EXISTS (SELECT 1 FROM gt_boxes g WHERE g.image_id = c.image_id
  AND {iou_sql('c', 'g')} >= 0.5) THEN 1 ELSE 0 END AS label FROM clusters c""", ctes=CLUSTER, big="label")
def _(v):
    return M.truth_label(X.cluster_boxes(v.cand_boxes, 0.45), v.gt_boxes, "cluster_id").select("image_id", "cluster_id", "label")


RECOVER = B01 + f""",
missed AS (SELECT g.* FROM gt_boxes g WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = g.image_id AND m.target = g.gt_id)),
rec_best AS MATERIALIZED (SELECT m.image_id, m.gt_id, max({{'iou': {iou_sql('c', 'm')}, 'score': c.score, 'source': c.source, 'pred_id': c.pred_id}}) AS b
  FROM missed m JOIN cand_boxes c ON m.image_id = c.image_id WHERE {iou_sql('c', 'm')} > 0 GROUP BY m.image_id, m.gt_id),
recovery AS MATERIALIZED (SELECT m.image_id, m.gt_id, coalesce(b.iou, 0.0) AS best_iou, b.source AS best_source, coalesce(b.score, 0.0) AS best_score,
  coalesce(b.iou, 0.0) >= 0.5 AS recoverable_50, coalesce(b.iou, 0.0) >= 0.4 AS recoverable_40, coalesce(b.iou, 0.0) >= 0.3 AS recoverable_30
  FROM missed m LEFT JOIN rec_best r ON m.image_id = r.image_id AND m.gt_id = r.gt_id)"""


def recovery(v):
    return M.recoverability(M.false_negative_rows(M.match_greedy(v.pred_boxes, v.gt_boxes), v.gt_boxes), v.cand_boxes)


@query("j09_recoverability", "SELECT * FROM recovery", ctes=RECOVER, dbl="best_iou best_score")
def _(v):
    return recovery(v)


@query("j09_recoverability_totals", """SELECT count(*) AS missed_faces, count(*) FILTER (recoverable_50) AS recoverable_50,
  count(*) FILTER (recoverable_40) AS recoverable_40, count(*) FILTER (recoverable_30) AS recoverable_30, avg(best_iou) AS mean_best_iou FROM recovery""",
       ctes=RECOVER, dbl="mean_best_iou")
def _(v):
    return M.recoverability_totals(recovery(v))


@query("j12_membership_join", """SELECT g.subgroup, count(DISTINCT g.image_id) AS images, count(b.gt_id) AS boxes FROM membership g
LEFT JOIN gt_boxes b ON g.image_id = b.image_id GROUP BY g.subgroup""")
def _(v):
    return M.membership_join(v.membership, v.gt_boxes)


@query("j16_grid_cross", """SELECT g.grid_id, count(a.pred_id) AS removed, (SELECT count(*) FROM pred_boxes) AS rows
FROM post_grid g LEFT JOIN gone a ON a.grid_id = g.grid_id GROUP BY g.grid_id""", ctes=GONE, big="grid_id")
def _(v):
    return X.removed_per_point(v.pred_boxes, X.postfilter_points(X.MARGINS, X.SIDES, X.TOP_SCORES))
