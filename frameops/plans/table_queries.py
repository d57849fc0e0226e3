"""Queries on validation, joins, set operations and ranking (V, J, T, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.functions import labels as L
from frameops.operators import joins as J
from frameops.operators import quality as Q
from frameops.operators import windows as W
from frameops.plans.registry import query
from frameops.plans.views import HARD_LABELS, LABELS, METHODS

C = F.col


def inventory_of(v):
    """Files as found: some absent, some with another checksum or size, some unreadable."""
    k = C("image_id")
    found = v.manifest.filter(C("integrity_status") == "valid")
    return found.select("relative_path", C("width").alias("actual_width"), F.when(C("custkey") % 2 == 0, C("height")).otherwise(C("height") - C("size_bytes") % 2).alias("actual_height"),
                        (k + F.when(C("size_bytes") % 5 == 0, 1).otherwise(0)).cast("string").alias("actual_checksum"), (C("size_bytes") % 7 != 0).alias("open_ok"))


def manifest_of(v):
    return v.manifest.select("relative_path", C("width").alias("image_width"), C("height").alias("image_height"), C("size_bytes").alias("file_size_bytes"),
                             C("image_id").cast("string").alias("checksum_sha256"), F.lit("ok").alias("read_status"))


INV = """inv AS MATERIALIZED (SELECT m.*, integrity_status = 'valid' AS found, CASE WHEN custkey % 2 = 0 THEN height ELSE height - size_bytes % 2 END AS ah,
  size_bytes % 5 <> 0 AS same_sum, size_bytes % 7 <> 0 AS opened FROM manifest m),
issues AS MATERIALIZED (SELECT relative_path, 'missing_file' AS issue FROM inv WHERE NOT found
  UNION ALL SELECT relative_path, 'checksum_mismatch' FROM inv WHERE found AND NOT same_sum
  UNION ALL SELECT relative_path, 'failed_open' FROM inv WHERE found AND NOT opened
  UNION ALL SELECT relative_path, 'dimension_mismatch' FROM inv WHERE found AND opened AND ah <> height
  UNION ALL SELECT relative_path, 'unexpected_dimensions' FROM inv WHERE found AND opened AND NOT (width >= 3840 AND ah >= 2160)
  UNION ALL SELECT relative_path, 'manifest_ok_but_failed_validation' FROM inv WHERE found AND NOT opened)"""


@query("v01_validate_manifest", "SELECT * FROM issues", ctes=INV)
def _(v):
    return Q.manifest_issues(manifest_of(v), inventory_of(v))


@query("v01_manifest_counts", """SELECT 'issue' AS section, issue AS key, CAST(count(*) AS DOUBLE) AS value FROM issues GROUP BY issue
UNION ALL SELECT 'resolution', CAST(width AS VARCHAR) || 'x' || CAST(ah AS VARCHAR), count(*) FROM inv WHERE found GROUP BY width, ah
UNION ALL SELECT 'size', 'mean', avg(size_bytes) FROM inv UNION ALL SELECT 'size', 'min', min(size_bytes) FROM inv UNION ALL SELECT 'size', 'max', max(size_bytes) FROM inv
UNION ALL SELECT 'native_4k', 'share', avg(CASE WHEN width >= 3840 AND ah >= 2160 THEN 1.0 ELSE 0.0 END) FROM inv WHERE found""", ctes=INV, dbl="value")
def _(v):
    return Q.manifest_counts(manifest_of(v), inventory_of(v))


@query("v02_is_4k", "SELECT image_id, (width >= 3840 AND height >= 2160) OR (width >= 2160 AND height >= 3840) AS native_4k FROM frames")
def _(v):
    return v.frames.select("image_id", L.is_4k(C("width"), C("height")).alias("native_4k"))


PROFILE = """prof AS MATERIALIZED (SELECT CASE WHEN grouping(camera_stream_id) = 0 THEN 'camera_stream_id' WHEN grouping(view_type) = 0 THEN 'view_type' WHEN grouping(participant_id) = 0 THEN 'participant_id'
  WHEN grouping(day_id) = 0 THEN 'day_id' WHEN grouping(resolution) = 0 THEN 'resolution' ELSE 'total' END AS dimension,
  coalesce(camera_stream_id, view_type, participant_id, day_id, resolution, 'all') AS value, count(*) AS frames, count(*) FILTER (integrity_status = 'valid') AS valid_frames,
  sum(size_bytes / (1024.0 * 1024.0)) AS storage_mb, avg(size_bytes) AS mean_size, min(size_bytes) AS min_size, max(size_bytes) AS max_size
  FROM (SELECT *, CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) AS resolution FROM frames)
  GROUP BY GROUPING SETS ((camera_stream_id), (view_type), (participant_id), (day_id), (resolution), ()))"""


@query("v03_profile_manifest", "SELECT * FROM prof", ctes=PROFILE, dbl="storage_mb mean_size")
def _(v):
    return Q.profile_manifest(v.frames)


EXPECTED = [("camera_stream_id", 16, "exact"), ("participant_id", 11, "near"), ("day_id", 12, "exact"), ("resolution", 1, "near"), ("view_type", 2, "exact")]


@query("v04_check_expected_counts", """SELECT e.dimension, e.expected, e.rule, coalesce(o.n, 0) AS observed, CASE WHEN e.rule = 'exact' THEN CASE WHEN coalesce(o.n, 0) = e.expected THEN 'PASS' ELSE 'FAIL' END
  WHEN abs(coalesce(o.n, 0) - e.expected) / CAST(e.expected AS DOUBLE) <= 0.05 THEN 'PASS' ELSE 'WARN' END AS status
FROM (VALUES ('camera_stream_id', 16, 'exact'), ('participant_id', 11, 'near'), ('day_id', 12, 'exact'), ('resolution', 1, 'near'), ('view_type', 2, 'exact')) AS e(dimension, expected, rule)
LEFT JOIN (SELECT dimension, count(*) FILTER (value <> 'unknown') AS n FROM prof GROUP BY dimension) o USING (dimension)""", ctes=PROFILE, big="expected")
def _(v):
    return Q.check_expected_counts(Q.profile_manifest(v.frames), EXPECTED)


@query("v05_verify_locked", """SELECT 'ego' AS manifest, 500 AS expected, count(*) AS rows, count(DISTINCT relative_path) AS unique_paths,
  count(DISTINCT relative_path) FILTER (integrity_status <> 'valid') AS missing_from_index, FALSE AS ok FROM manifest WHERE view_type = 'egocentric'
UNION ALL SELECT 'exo', 500, 2 * count(*), count(DISTINCT relative_path), count(DISTINCT relative_path) FILTER (integrity_status <> 'valid'), FALSE FROM manifest WHERE view_type = 'exocentric'""",
       big="expected rows")
def _(v):
    ego = v.manifest.filter(C("view_type") == "egocentric").select(F.concat(F.lit("data/raw/"), F.replace("relative_path", F.lit("/"), F.lit("\\"))).alias("image_path"))
    ego = ego.withColumn("image_path", F.replace("image_path", F.lit("\\"), F.lit("/")))
    exo = v.manifest.filter(C("view_type") == "exocentric").select(F.replace("relative_path", F.lit("/"), F.lit("\\")).alias("relative_path"))
    index = v.manifest.filter(C("integrity_status") == "valid")
    return Q.verify_locked({"ego": (ego, 500), "exo": (exo.union(exo), 500)}, index)


def raw_boxes(v):
    """Candidates as text, some coordinates not whole numbers."""
    bad = C("score") < 0.05
    return v.cand_boxes.select("image_id", "pred_id", F.when(bad, F.concat(C("x1").cast("string"), F.lit("px"))).otherwise(C("x1").cast("string")).alias("x1"),
                               *[C(k).cast("string").alias(k) for k in ("y1", "x2", "y2")])


def known_frames(v):
    good = C("integrity_status") == "valid"
    wide = v.frames.filter(C("camera_stream_id") != "reading")
    return wide.select("image_id", F.when(good, C("width")).alias("width"), F.when(good, C("height")).alias("height"))


BOXV = """chk AS MATERIALIZED (SELECT b.image_id, b.pred_id, CASE WHEN f.camera_stream_id = 'reading' THEN 'unknown_image' WHEN f.integrity_status <> 'valid' THEN 'missing_image'
  WHEN b.score < 0.05 THEN 'non_integer_coordinate' WHEN NOT (0 <= x1 AND x1 < x2 AND x2 <= width AND 0 <= y1 AND y1 < y2 AND y2 <= height) THEN 'out_of_bounds' END AS issue
  FROM cand_boxes b JOIN frames f ON b.image_id = f.image_id)"""


@query("v06_validate_boxes", "SELECT * FROM chk", ctes=BOXV)
def _(v):
    return Q.box_issues(raw_boxes(v), known_frames(v)).select("image_id", "pred_id", "issue")


@query("v06_box_issue_counts", "SELECT coalesce(issue, 'valid') AS issue, count(*) AS boxes, count(DISTINCT image_id) AS images FROM chk GROUP BY 1", ctes=BOXV)
def _(v):
    return Q.box_issue_counts(Q.box_issues(raw_boxes(v), known_frames(v)))


@query("v07_check_header", "SELECT image_id, 'notes' AS missing, 'source' AS unexpected FROM frames")
def _(v):
    report = Q.check_header(v.cand_boxes.columns, ["image_id", "x1", "y1", "x2", "y2", "notes"], ["score", "pred_id"])
    return v.frames.select("image_id", F.lit("|".join(report["missing"])).alias("missing"), F.lit("|".join(report["unexpected"])).alias("unexpected"))


@query("v08_overlapping_owners", "SELECT image_id, 'detection' AS first_owner, 'review' AS last_owner FROM conditions WHERE large_face = 1 AND high_clutter = 1")
def _(v):
    return Q.overlapping_owners({"detection": v.conditions.filter("large_face = 1"), "review": v.conditions.filter("high_clutter = 1")}, "image_id")


@query("v09_min_per_condition", """SELECT l.label, coalesce(n, 0) AS rows FROM (SELECT unnest([""" + ", ".join(f"'{k}'" for k in HARD_LABELS) + """, 'unseen']) AS label) l LEFT JOIN (
  SELECT label, count(*) AS n FROM (SELECT unnest(string_split(m, '|')) AS label FROM (SELECT """ + "concat_ws('|', " + ", ".join(f"CASE WHEN {col} THEN '{k}' END" for k, col in L.CONDITION_FLAGS) + """) AS m FROM quality_frame)) GROUP BY label) USING (label) WHERE coalesce(n, 0) < 1200""")
def _(v):
    rows = v.quality_frame.select(F.explode(L.condition_membership()).alias("label"))
    return Q.short_conditions(rows, "label", [*HARD_LABELS, "unseen"], 1200)


@query("v10_levels_per_dimension", """SELECT 'camera_stream_id' AS dimension, count(DISTINCT camera_stream_id) AS levels, count(DISTINCT camera_stream_id) >= 3 AS ok FROM frames
UNION ALL SELECT 'view_type', count(DISTINCT view_type), count(DISTINCT view_type) >= 3 FROM frames UNION ALL SELECT 'day_id', count(DISTINCT day_id), count(DISTINCT day_id) >= 3 FROM frames
UNION ALL SELECT 'participant_id', count(DISTINCT participant_id), count(DISTINCT participant_id) >= 3 FROM frames""")
def _(v):
    return Q.levels_per_dimension(v.frames, ["camera_stream_id", "view_type", "day_id", "participant_id"])


@query("v11_repair_metadata", """SELECT image_id, day_id, camera_stream_id, CASE WHEN size_bytes % 3 = 1 THEN CASE WHEN view_type = 'egocentric' THEN camera_stream_id ELSE 'none' END ELSE participant_id END AS participant_id, view_type FROM manifest""")
def _(v):
    hole = C("size_bytes") % 3
    broken = v.manifest.select("image_id", "relative_path", F.when(hole == 0, F.lit("")).otherwise(C("day_id")).alias("day_id"), "camera_stream_id",
                               F.when(hole == 1, F.lit(" NaN")).otherwise(C("participant_id")).alias("participant_id"),
                               F.when(hole != 2, C("view_type")).alias("view_type"))
    return Q.repair_metadata(broken).drop("relative_path")


@query("v12_ensure_columns", "SELECT image_id, 0.0 AS blur_score, FALSE AS no_face_flag, '' AS blur_level, 0 AS n_matches, width FROM frames", dbl="blur_score", big="n_matches")
def _(v):
    out = Q.ensure_columns(v.frames.select("image_id", "width"), ["blur_score", "width"], ["no_face_flag"], ["blur_level"], ["condition_matches"])
    return out.select("image_id", "blur_score", "no_face_flag", "blur_level", F.size("condition_matches").alias("n_matches"), "width")


@query("v13_relabel", "SELECT image_id, CASE camera_stream_id WHEN 'living1' THEN 'living' WHEN 'living2' THEN 'living' ELSE camera_stream_id END AS camera_stream_id FROM frames")
def _(v):
    maps = {"camera_stream_id": {"living1": "living", "living2": "living"}, "absent": {"a": "b"}}
    return Q.relabel(v.frames.select("image_id", "camera_stream_id"), maps)


@query("v14_metric_readiness", """SELECT *, CASE WHEN method IN ('diffusion_low_step') THEN 'not_policy_ready_quality_limited' WHEN success_rows < 500 THEN 'bounded_policy_candidate_partial_success'
  WHEN perceptual_rows >= 500 AND reid_rows > 0 AND runtime_rows >= 450 THEN 'policy_ready_per_image_metrics' WHEN manifest_rows >= 450 THEN 'local_metric_recompute_needed' ELSE 'not_ready_missing_outputs' END AS readiness_status
FROM (SELECT method, count(*) AS manifest_rows, count(*) FILTER (status IN ('ok', 'existing')) AS success_rows, count(ssim) AS perceptual_rows, count(reid_a) AS reid_rows, count(runtime_seconds) AS runtime_rows FROM method_metrics GROUP BY method)""")
def _(v):
    return Q.metric_readiness(v.method_metrics, ["diffusion_low_step"])


MEMBER = "membership WHERE subgroup <> 'overall'"


@query("v15_category_coverage", f"""SELECT s.category, m.method, s.support_count, coalesce(output_rows, 0) AS output_rows, coalesce(success_rows, 0) AS success_rows, coalesce(perceptual_rows, 0) AS perceptual_rows,
  coalesce(reid_rows, 0) AS reid_rows, coalesce(runtime_rows, 0) AS runtime_rows, coalesce(perceptual_rows = support_count AND (reid_rows > 0 OR s.category = 'no_face') AND runtime_rows > 0, FALSE) AS category_policy_ready
FROM (SELECT subgroup AS category, count(*) AS support_count FROM {MEMBER} GROUP BY subgroup) s CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in METHODS)}, 'fams']) AS method) m
LEFT JOIN (SELECT g.subgroup AS category, x.method, count(*) AS output_rows, count(*) FILTER (status IN ('ok', 'existing')) AS success_rows, count(ssim) AS perceptual_rows, count(reid_a) AS reid_rows, count(runtime_seconds) AS runtime_rows
  FROM membership g JOIN method_metrics x ON g.image_id = x.image_id GROUP BY g.subgroup, x.method) c ON s.category = c.category AND m.method = c.method""")
def _(v):
    return Q.category_coverage(v.conditions, v.method_metrics, LABELS, [*METHODS, "fams"])


@query("v16_canonical_override", """SELECT m.image_id, m.method, CASE WHEN c.image_id IS NOT NULL THEN coalesce(c.runtime + 1, m.runtime_seconds) ELSE m.runtime_seconds END AS runtime_seconds,
  coalesce(c.runtime + 1 <> m.runtime_seconds, FALSE) AS conflict
FROM method_metrics m LEFT JOIN (SELECT image_id, method, runtime_seconds AS runtime FROM method_metrics WHERE method = 'blur') c ON m.image_id = c.image_id AND m.method = c.method""", dbl="runtime_seconds")
def _(v):
    canonical = v.method_metrics.filter(C("method") == "blur").select("image_id", "method", (C("runtime_seconds") + 1).alias("runtime_seconds"))
    rows = v.method_metrics.select("image_id", "method", "runtime_seconds")
    return Q.canonical_override(rows, canonical, ["image_id", "method"], "runtime_seconds")


@query("v17_no_action_safety", """SELECT p.image_id, 'no_action_copy' AS route, p.no_face AS predicted_no_face, coalesce(n, 0) AS candidate_boxes, CASE WHEN coalesce(n, 0) = 0 AND p.no_face = 1 THEN 'SAFE' ELSE 'UNSAFE' END AS verdict
FROM pred_conditions p LEFT JOIN (SELECT image_id, count(*) AS n FROM cand_boxes GROUP BY image_id) USING (image_id) WHERE p.no_face = 1 OR p.box_count = 0""")
def _(v):
    quiet = (C("no_face") == 1) | (C("box_count") == 0)
    routes = v.pred_conditions.select("image_id", F.when(quiet, "no_action_copy").otherwise("blur").alias("route"), C("no_face").alias("predicted_no_face"))
    return Q.no_action_safety(routes, v.cand_boxes)


@query("v18_traceability_check", """SELECT m.relative_path AS table_path, 'x/' || m.day_id AS source_path, m.integrity_status = 'valid' AS table_path_exists, FALSE AS source_path_exists, 'broken' AS status FROM manifest m WHERE m.view_type = 'exocentric'
UNION ALL SELECT relative_path, relative_path, integrity_status = 'valid', integrity_status = 'valid', CASE WHEN integrity_status = 'valid' THEN 'traced' ELSE 'broken' END FROM manifest WHERE view_type = 'egocentric'""")
def _(v):
    source = F.when(C("view_type") == "egocentric", C("relative_path")).otherwise(F.concat(F.lit("x/"), C("day_id")))
    links = v.manifest.select(C("relative_path").alias("table_path"), source.alias("source_path"))
    files = v.manifest.filter(C("integrity_status") == "valid").select(C("relative_path").alias("path"))
    return Q.traceability_check(links, files)


@query("v19_contract_check", """SELECT 'metrics' AS contract, 'ssim' AS field, TRUE AS present, count(*) FILTER (ssim IS NULL) AS missing_rows, count(*) FILTER (ssim IS NULL) = 0 AS ok FROM method_metrics
UNION ALL SELECT 'metrics', 'status', TRUE, 0, TRUE UNION ALL SELECT 'runtime', 'runtime_seconds', TRUE, count(*) FILTER (runtime_seconds IS NULL), count(*) FILTER (runtime_seconds IS NULL) = 0 FROM method_metrics
UNION ALL SELECT 'runtime', 'device', FALSE, count(*), FALSE FROM method_metrics""")
def _(v):
    return Q.contract_check(v.method_metrics, {"metrics": ["ssim", "status"], "runtime": ["runtime_seconds", "device"]})


# joins


def reid_side(v):
    return v.method_metrics.filter(C("reid_a").isNotNull()).select("image_id", "method", "reid_a", "reid_b")


@query("j01_metric_join", "SELECT image_id, method, box_count, status, ssim, lpips, reid_a, reid_b FROM method_metrics", dbl="ssim lpips reid_a reid_b")
def _(v):
    m = v.method_metrics
    perceptual = m.filter(C("ssim").isNotNull() | C("lpips").isNotNull()).select("image_id", "method", "ssim", "lpips")
    return J.metric_join(v.conditions.select("image_id", "box_count"), m.select("image_id", "method", "status"), perceptual, reid_side(v))


PAIRS = """xpairs AS MATERIALIZED (SELECT e.day_id, e.timestamp_id, e.image_id AS egocentric_image_id, x.image_id AS exocentric_image_id, e.relative_path AS egocentric_relative_path,
  x.relative_path AS exocentric_relative_path, e.camera_stream_id AS egocentric_stream_id, x.camera_stream_id AS exocentric_stream_id
  FROM manifest e JOIN manifest x ON e.day_id = x.day_id AND e.timestamp_id = x.timestamp_id WHERE e.integrity_status = 'valid' AND x.integrity_status = 'valid' AND e.view_type = 'egocentric' AND x.view_type = 'exocentric')"""


@query("j02_cross_view_pairs", "SELECT day_id, timestamp_id, egocentric_image_id, exocentric_image_id, egocentric_stream_id, exocentric_stream_id FROM xpairs", ctes=PAIRS)
def _(v):
    return J.cross_view_pairs(v.manifest).select("day_id", "timestamp_id", "egocentric_image_id", "exocentric_image_id", "egocentric_stream_id", "exocentric_stream_id")


@query("j03_control_pairs", """SELECT p.egocentric_image_id, p.exocentric_image_id, s.n.t AS control_timestamp_id, s.n.i AS control_exocentric_image_id FROM xpairs p JOIN (
  SELECT day_id, exocentric_stream_id, timestamp_id, coalesce(lead({'t': timestamp_id, 'i': i}) OVER w, first_value({'t': timestamp_id, 'i': i}) OVER w) AS n
  FROM (SELECT day_id, exocentric_stream_id, timestamp_id, min(exocentric_image_id) AS i FROM xpairs GROUP BY ALL) WINDOW w AS (PARTITION BY day_id, exocentric_stream_id ORDER BY timestamp_id)) s
  USING (day_id, exocentric_stream_id, timestamp_id) WHERE s.n.t <> p.timestamp_id""", ctes=PAIRS)
def _(v):
    return J.control_pairs(J.cross_view_pairs(v.manifest)).select("egocentric_image_id", "exocentric_image_id", "control_timestamp_id", "control_exocentric_image_id")


@query("j04_anti_keys", "SELECT image_id FROM conditions WHERE large_face = 0 AND high_clutter = 0")
def _(v):
    c = v.conditions
    return J.anti_keys(c.select("image_id"), [c.filter("large_face = 1"), c.filter("high_clutter = 1")], "image_id")


@query("j05_join_validated", "SELECT image_id, method, day_id, ssim FROM method_metrics JOIN frames USING (image_id)", dbl="ssim")
def _(v):
    return J.join_validated(v.method_metrics, v.frames.select("image_id", "day_id"), ["image_id"], "many_to_one").select("image_id", "method", "day_id", "ssim")


PROFILES = [("privacy", "solid_mask", "fill", "fill"), ("balanced", "layered", "fill", "blur"), ("utility", "blur", "blur", "pixelate")]
TIERS = [("accelerated_full", 12288, True), ("accelerated_efficient", 6144, True), ("accelerated_compact", 0, True), ("portable_cpu", 0, False)]


@query("j10_profile_lookup", """SELECT image_id, focus, CASE focus WHEN 'privacy' THEN 'solid_mask' WHEN 'balanced' THEN 'layered' ELSE 'blur' END AS face_operator,
  CASE focus WHEN 'privacy' THEN 'fill' WHEN 'balanced' THEN 'blur' ELSE 'pixelate' END AS text_operator
FROM (SELECT image_id, CASE WHEN view_type = 'exocentric' THEN 'utility' WHEN day_id IN ('day1', 'day2', 'day3') THEN 'privacy' ELSE 'balanced' END AS focus FROM frames)""")
def _(v):
    profiles = v.spark.createDataFrame(PROFILES, "focus string, face_operator string, screen_operator string, text_operator string")
    focus = F.when(C("view_type") == "exocentric", "utility").when(C("day_id").isin("day1", "day2", "day3"), "privacy").otherwise("balanced")
    return J.profile_lookup(v.frames.select("image_id", focus.alias("focus")), profiles).drop("screen_operator")


@query("j10_tier_lookup", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'portable_cpu' WHEN c_acctbal * 2 >= 12288 THEN 'accelerated_full' WHEN c_acctbal * 2 >= 6144 THEN 'accelerated_efficient'
  WHEN c_acctbal * 2 >= 0 THEN 'accelerated_compact' END AS tier FROM (SELECT c_custkey, c_mktsegment, floor(c_acctbal) AS c_acctbal FROM customer)""")
def _(v):
    tiers = v.spark.createDataFrame(TIERS, "tier string, min_vram_mb bigint, requires_cuda boolean")
    rows = v.table("customer").select("c_custkey", (F.floor("c_acctbal") * 2).alias("vram_mb"), (C("c_mktsegment") != "MACHINERY").alias("cuda"))
    out = J.tier_lookup(rows.withColumn("vram_mb", F.when(C("cuda"), C("vram_mb")).otherwise(F.greatest(C("vram_mb"), F.lit(0)))), tiers)
    return out.select("c_custkey", "tier")


@query("j11_eligibility_join", """SELECT method, n AS five_case_n, f AS five_case_fails, CAST(f AS DOUBLE) / n AS five_case_fail_rate, r AS structured_author_fail_rate FROM (
  SELECT method, count(*) AS n, count(*) FILTER (status = 'failed') AS f, avg(CASE WHEN reid_a > 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM method_metrics GROUP BY method)""", dbl="five_case_fail_rate structured_author_fail_rate")
def _(v):
    m = v.method_metrics
    five = m.select("method", F.when(C("status") == "failed", "No").otherwise("yes").alias("default_route_pass"))
    review = m.groupBy("method").agg(F.avg(F.when(C("reid_a") > 0.5, 1.0).otherwise(0.0)).alias("structured_author_fail_rate"))
    return J.eligibility_join(m.select("method").distinct(), five, review)


@query("j13_condition_frame", """SELECT image_id, box_count, no_face = 1 AS manual_no_face, CASE WHEN small_face = 1 THEN TRUE ELSE large_face = 1 AND FALSE END AS manual_small_face, edge_or_partial_face = 1 AS manual_edge_or_partial_face, high_clutter = 1 OR low_light_or_dim = 1 AS manual_high_clutter, text_present
FROM conditions JOIN (SELECT image_id, visible_text_flag AS text_present FROM quality_frame) USING (image_id)""")
def _(v):
    c = v.conditions
    yes = lambda k: F.when(C(k) == 1, "Yes").otherwise("no")
    reviewed = c.select(
        "image_id", "box_count", F.when(C("no_face") == 1, "no_face").otherwise("some").alias("face_count_category"),
        F.when(C("large_face") == 1, "large").alias("face_scale_category"), yes("edge_or_partial_face").alias("edge_partial_face"),
        yes("profile_or_occluded_face").alias("profile_occluded_face"), yes("downward_egocentric_view").alias("downward_egocentric_view"),
        yes("motion_blur_or_low_sharpness").alias("blur_low_sharpness"), yes("low_light_or_dim").alias("low_light_dim"), F.when(C("low_light_or_dim") == 1, "HIGH").alias("clutter_level"),
        L.compose_label([F.when(C("small_face") == 1, F.lit("small")), F.when(C("high_clutter") == 1, F.lit("clutter_high"))]).alias("condition_label"))
    risk = v.quality_frame.select("image_id", C("visible_text_flag").alias("text_present"))
    out = J.condition_frame(v.frames, reviewed, risk)
    return out.select("image_id", "box_count", "manual_no_face", "manual_small_face", "manual_edge_or_partial_face", "manual_high_clutter", "text_present")


@query("j14_label_source_hybrid", "SELECT c.image_id, c.no_face, c.large_face, p.low_light_or_dim, p.high_clutter FROM conditions c JOIN pred_conditions p USING (image_id)")
def _(v):
    return J.label_source_hybrid(v.conditions, v.pred_conditions, "image_id", ["no_face", "large_face", "low_light_or_dim", "high_clutter"], ["low_light_or_dim", "high_clutter"])


@query("j15_scr_box_hybrid", """SELECT image_id, CASE WHEN multi_face = 1 OR large_face = 1 THEN c.large_face ELSE p.large_face END AS large_face, CASE WHEN c.image_id IS NULL THEN 0 ELSE p.low_light_or_dim END AS low_light_or_dim
FROM (SELECT image_id, large_face, multi_face FROM conditions) c JOIN (SELECT image_id, large_face, low_light_or_dim FROM pred_conditions) p USING (image_id)""".replace("multi_face = 1 OR large_face = 1", "c.multi_face = 1 OR c.large_face = 1").replace("SELECT image_id, CASE", "SELECT c.image_id, CASE"))
def _(v):
    geometry = v.conditions.filter("multi_face = 1 OR large_face = 1").select("image_id", "large_face")
    scene = v.pred_conditions.select("image_id", "large_face", "low_light_or_dim")
    return J.scr_box_hybrid(geometry, scene, "image_id", ["large_face"], ["low_light_or_dim"])


# set operations and sorts


@query("t01_concat_methods", "SELECT image_id, method, CASE WHEN method = 'blur' THEN ssim + 1 ELSE ssim END AS ssim, CASE WHEN method = 'blur' THEN 1 END AS rerun FROM method_metrics", dbl="ssim", big="rerun")
def _(v):
    base = v.method_metrics.select("image_id", "method", "ssim")
    rerun = base.filter(C("method") == "blur").withColumn("ssim", C("ssim") + 1).withColumn("rerun", F.lit(1))
    return J.concat_methods([base, rerun], ["image_id", "method"])


@query("t02_union_sources", "SELECT image_id FROM pred_boxes UNION SELECT image_id FROM gt_boxes")
def _(v):
    return J.union_sources(v.pred_boxes, v.gt_boxes)


@query("t03_intersect_images", "SELECT image_id FROM pred_boxes INTERSECT SELECT image_id FROM conditions WHERE no_face = 1")
def _(v):
    return J.intersect_images(v.pred_boxes, v.conditions.filter("no_face = 1"))


@query("t04_except_paths", "SELECT relative_path FROM manifest EXCEPT SELECT relative_path FROM manifest WHERE integrity_status = 'valid'")
def _(v):
    return J.except_paths(v.manifest, v.manifest.filter(C("integrity_status") == "valid"))


@query("t05_multi_key_sort", "SELECT image_id, face_count, blur_score FROM quality_frame ORDER BY face_count DESC, blur_score, relative_path LIMIT 15", dbl="blur_score")
def _(v):
    order = [C("face_count").desc(), C("blur_score").asc(), C("relative_path").asc()]
    return J.multi_key_sort(v.quality_frame, order, 15).select("image_id", "face_count", "blur_score")


@query("t06_pivot_scores", "SELECT subgroup, avg(score) FILTER (source = 'rfdetr') AS rfdetr, avg(score) FILTER (source = 'scrfd') AS scrfd, avg(score) FILTER (source = 'yolo') AS yolo FROM membership JOIN cand_boxes USING (image_id) GROUP BY subgroup", dbl="rfdetr scrfd yolo")
def _(v):
    means = v.membership.join(v.cand_boxes, "image_id").groupBy("subgroup", "source").agg(F.avg("score").alias("s"))
    return J.pivot_scores(means, "subgroup", "source", ["rfdetr", "scrfd", "yolo"], "s")


# ranking


MEANS = "cm AS (SELECT g.subgroup, x.method, avg(ssim) AS ssim, avg(lpips) AS lpips FROM membership g JOIN method_metrics x USING (image_id) GROUP BY ALL)"


@query("w01_dense_rank_scores", "SELECT subgroup, method, ssim, lpips, dense_rank() OVER (PARTITION BY subgroup ORDER BY ssim DESC) AS ssim_rank, dense_rank() OVER (PARTITION BY subgroup ORDER BY lpips DESC) AS lpips_rank FROM cm",
       ctes=MEANS, dbl="ssim lpips")
def _(v):
    means = v.membership.join(v.method_metrics, "image_id").groupBy("subgroup", "method").agg(F.avg("ssim").alias("ssim"), F.avg("lpips").alias("lpips"))
    return W.dense_rank_scores(means, ["subgroup"], ["ssim", "lpips"])


@query("w03_quantile_label", """SELECT image_id, CASE WHEN 3 * (r - 1) <= n - 1 THEN 'low' WHEN 3 * (r - 1) <= 2 * (n - 1) THEN 'medium' ELSE 'high' END AS blur_level
FROM (SELECT image_id, row_number() OVER (ORDER BY blur_score, image_id) AS r, count(*) OVER () AS n FROM quality_frame)""")
def _(v):
    return W.quantile_label(v.quality_frame.select("image_id", "blur_score"), "blur_score", "image_id", name="blur_level").select("image_id", "blur_level")


@query("w04_low_quantile_flag", "SELECT image_id, blur_score <= (SELECT quantile_cont(blur_score, 0.25) FROM quality_frame) AS flag FROM quality_frame")
def _(v):
    return W.low_quantile_flag(v.quality_frame.select("image_id", "blur_score"), "blur_score").select("image_id", "flag")


@query("w05_pct_dense_rank", """SELECT image_id, round(CAST(d AS DOUBLE) / max(d) OVER (PARTITION BY day_id), 3) AS label_confidence FROM (
  SELECT image_id, day_id, dense_rank() OVER (PARTITION BY day_id ORDER BY text_score DESC) AS d FROM quality_frame)""", dbl="label_confidence")
def _(v):
    return W.pct_dense_rank(v.quality_frame.select("image_id", "day_id", "text_score"), ["day_id"], "text_score").select("image_id", "label_confidence")


@query("w06_running_pr", """SELECT source, image_id, pred_id, sum(hit) OVER w AS hits, row_number() OVER w AS seen FROM (
  SELECT source, image_id, pred_id, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS hit FROM cand_boxes)
  WINDOW w AS (PARTITION BY source ORDER BY score DESC, image_id, pred_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", big="hits")
def _(v):
    from frameops.operators.scale import running_totals

    order = [C("score").desc(), C("image_id"), C("pred_id")]
    hit = F.when(C("score") >= 0.5, 1).otherwise(0)
    return running_totals(v.cand_boxes.select("source", "image_id", "pred_id", "score"), ["source"], order, {"hits": hit, "seen": F.lit(1)}).drop("score")


@query("w08_head_k_per_group", """SELECT image_id, day_id, rank FROM (SELECT image_id, day_id, row_number() OVER (PARTITION BY day_id, camera_stream_id ORDER BY relative_path) AS rank FROM quality_frame) WHERE rank <= 2""")
def _(v):
    return W.head_k(v.quality_frame, ["day_id", "camera_stream_id"], [C("relative_path")], 2).select("image_id", "day_id", "rank")


@query("w09_keep_last", "SELECT camera_stream_id, max(image_id) AS image_id FROM frames GROUP BY camera_stream_id")
def _(v):
    return W.keep_one(v.frames.select("camera_stream_id", "image_id"), ["camera_stream_id"], [C("image_id").desc()])


@query("w11_richest_source_wins", "SELECT subgroup, method, CASE WHEN method = 'blur' THEN 2.0 ELSE ssim END AS ssim FROM cm", ctes=MEANS, dbl="ssim")
def _(v):
    means = v.membership.join(v.method_metrics, "image_id").groupBy("subgroup", "method").agg(F.avg("ssim").alias("ssim"))
    return W.richest_source_wins([means, means.filter(C("method") == "blur").withColumn("ssim", F.lit(2.0))], ["subgroup", "method"])
