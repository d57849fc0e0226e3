"""Queries on sources and sinks (S, K).  Files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameops.lineage import scratch
from frameops.operators import matching as M
from frameops.plans.box_queries import AUDIT
from frameops.plans.registry import query
from frameops.plans.sample_queries import H
from frameops.plans.views import LABELS
from frameops.sources import scans as S
from frameops.sources import sinks as K

C = F.col
CORNERS = ["x1", "y1", "x2", "y2"]


def manifest_rows(v):
    return v.manifest.select(
        "relative_path", F.concat(C("timestamp_id"), F.lit(".webp")).alias("file_name"), F.lit(".webp").alias("file_ext"), C("size_bytes").alias("file_size_bytes"),
        F.lit(None).cast("string").alias("checksum_sha256"), C("width").alias("image_width"), C("height").alias("image_height"), "camera_stream_id", "view_type",
        "participant_id", C("day_id").alias("day_or_session_id"), F.lit("ok").alias("read_status"), "integrity_status")


@query("s01_scan_manifest", "SELECT relative_path, size_bytes AS file_size_bytes, day_id, timestamp_id, CAST(NULL AS VARCHAR) AS checksum_sha256 FROM manifest WHERE integrity_status = 'valid'")
def _(v):
    path = scratch(v.spark, "manifest")
    manifest_rows(v).write.csv(path, header=True, nullValue="null")
    return S.scan_manifest(v.spark, path).select("relative_path", "file_size_bytes", "day_id", "timestamp_id", "checksum_sha256")


@query("s02_scan_filtered", "SELECT image_id FROM manifest WHERE integrity_status = 'valid' AND day_id = 'day3' AND view_type = 'egocentric'")
def _(v):
    return S.scan_filtered(v.manifest, {"day_id": "day3", "view_type": "egocentric"}).select("image_id")


@query("s03_inventory_files", """SELECT 'day' || doc_id % 5 || '/' || kind || '/' || lang || '/' || doc_id || '.TXT' AS relative_path, doc_id || '.TXT' AS file_name, '.txt' AS file_ext, CAST(strlen(coalesce(text, '')) AS BIGINT) AS file_size_bytes,
  sha256(coalesce(text, '')) AS checksum_sha256, lang AS camera_stream_id, CASE kind WHEN 'members' THEN 'egocentric' WHEN 'fixed' THEN 'exocentric' ELSE 'unknown' END AS view_type, 'day' || doc_id % 5 AS day_id
FROM (SELECT doc_id, text, lang, CASE WHEN doc_id % 3 = 0 THEN 'members' ELSE 'fixed' END AS kind FROM documents)""")
def _(v):
    # one file per document, then the files of the folder; documents that share an id get folders of their own
    root = scratch(v.spark, "files")
    kind = F.when(C("doc_id") % 3 == 0, "members").otherwise("fixed")
    copy = F.row_number().over(Window.partitionBy("doc_id").orderBy("lang", "text"))
    path = F.concat(copy, F.lit("/day"), C("doc_id") % 5, F.lit("/"), kind, F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".TXT"))
    K.write_files(v.table("documents").withColumn("path", path), root, "path", "text")
    out = S.inventory_files(v.spark, root, skip=1)
    return out.select("relative_path", "file_name", "file_ext", "file_size_bytes", "checksum_sha256", "camera_stream_id", "view_type", "day_id")


@query("s04_scan_boxes", "SELECT image_id, x1, y1, x2, y2, score, source AS detector_name FROM pred_boxes", dbl="score")
def _(v):
    path = scratch(v.spark, "boxes")
    v.pred_boxes.select("image_id", *CORNERS, "score", C("source").alias("detector_name")).write.csv(path, header=True)
    return S.scan_boxes(v.spark, path, "pred").withColumn("image_id", C("image_id").cast("bigint"))


def messy(v):
    """Two untyped box tables: one keyed by image_id, one by relative_path; some coordinates malformed."""
    bad = C("score") < 0.05
    x1 = F.when(bad, "n/a").otherwise(F.concat(C("x1").cast("string"), F.lit(".75")))
    first = v.cand_boxes.filter(C("source") == "rfdetr").select(C("image_id").cast("string").alias("image_id"), x1.alias("x1"), *CORNERS[1:], "score", C("source").alias("detector_name"))
    second = v.cand_boxes.filter(C("source") != "rfdetr").select(C("image_id").cast("string").alias("relative_path"), *CORNERS, C("source").alias("detector_name"),
                                                                  F.when(C("score") > 0.9, "small_face").alias("condition_label"))
    return [first, second]


def messy_files(v):
    paths = []
    for df in messy(v):
        paths.append(scratch(v.spark, "messy"))
        df.write.csv(paths[-1], header=True)
    return paths


@query("s05_boxes_permissive", """SELECT CAST(image_id AS VARCHAR) AS image_id, CASE WHEN source = 'rfdetr' THEN CAST(trunc(CAST(CAST(x1 AS VARCHAR) || '.75' AS DOUBLE)) AS BIGINT) ELSE x1 END AS x1, y1, x2, y2,
  CASE WHEN source = 'rfdetr' THEN score ELSE 1.0 END AS score, source AS detector_name, CASE WHEN source <> 'rfdetr' AND score > 0.9 THEN 'small_face' END AS condition_label
FROM cand_boxes WHERE NOT (source = 'rfdetr' AND score < 0.05)""", dbl="score")
def _(v):
    return S.scan_boxes_permissive(v.spark, messy_files(v))


@query("s05_boxes_per_image", """SELECT CAST(image_id AS VARCHAR) AS image_id, count(*) AS box_count, string_agg(DISTINCT source, '+' ORDER BY source) AS detectors,
  coalesce(string_agg(DISTINCT CASE WHEN source <> 'rfdetr' AND score > 0.9 THEN 'small_face' END, '+'), '') AS labels FROM cand_boxes WHERE NOT (source = 'rfdetr' AND score < 0.05) GROUP BY image_id""")
def _(v):
    out = S.boxes_per_image(S.scan_boxes_permissive(v.spark, messy_files(v)))
    return out.select("image_id", "box_count", F.array_join("detectors", "+").alias("detectors"), F.array_join("labels", "+").alias("labels"))


def json_boxes(v):
    """One JSON list per truth box; some documents are cut off, some boxes have no width."""
    x2 = F.when(C("y1") % 10 == 3, C("x1")).otherwise(C("x2"))
    text = F.format_string('[{"x1":%d,"y1":%d,"x2":%d,"y2":%d}]', C("x1"), C("y1"), x2, C("y2"))
    return v.gt_boxes.select("image_id", "gt_id", F.when(C("y1") % 10 == 7, F.substring(text, 1, 9)).otherwise(text).alias("boxes_json"))


@query("s06_explode_boxes_json", "SELECT image_id, gt_id, x1, y1, CASE WHEN y1 % 10 = 3 THEN x1 ELSE x2 END AS x2, y2 FROM gt_boxes WHERE y1 % 10 <> 7", dbl="x1 y1 x2 y2")
def _(v):
    return S.explode_boxes_json(json_boxes(v), "boxes_json")


@query("s06_explode_boxes_json_strict", "SELECT image_id, gt_id, x1, y1, x2, y2 FROM gt_boxes WHERE y1 % 10 NOT IN (3, 7)", dbl="x1 y1 x2 y2")
def _(v):
    return S.explode_boxes_json(json_boxes(v), "boxes_json", strict=True)


@query("s07_scan_metric_json", "SELECT image_id, method, ssim FROM method_metrics", dbl="ssim")
def _(v):
    docs = v.method_metrics.groupBy("image_id").agg(F.collect_list(F.struct("image_id", "method", "ssim")).alias("detailed"))
    path = scratch(v.spark, "metrics")
    docs.select(F.to_json(F.struct("detailed")).alias("doc")).write.text(path)
    return S.scan_metric_json(v.spark, path, "image_id bigint, method string, ssim double", per_line=True)


@query("s08_scan_jobs_jsonl", "SELECT image_id, method, status FROM method_metrics WHERE status <> 'existing'")
def _(v):
    path = scratch(v.spark, "jobs")
    v.method_metrics.filter(C("status") != "existing").select("image_id", "method", "status").write.json(path)
    return S.scan_jobs_jsonl(v.spark, path, "image_id bigint, method string, status string")


@query("s09_select_shard_index", "SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM frames) WHERE i % 5 = 3")
def _(v):
    return S.select_shard(v.frames.select("image_id"), 3, 5, "image_id", by="index")


@query("s09_select_shard_hash", f"SELECT image_id FROM frames WHERE CAST('0x' || substr({H.format('CAST(image_id AS VARCHAR)')}, 1, 8) AS BIGINT) % 5 = 3")
def _(v):
    return S.select_shard(v.frames.select("image_id"), 3, 5, "image_id")


REGISTRY = """{"profiles": {"privacy": {"objective_id": "privacy_first", "face_operator": "solid_mask", "screen_operator": "fill", "text_operator": "fill"},
"balanced": {"objective_id": "utility_under_privacy_floor", "face_operator": "layered", "screen_operator": "fill", "text_operator": "blur"},
"utility": {"objective_id": "utility_priority", "face_operator": "blur", "screen_operator": "blur", "text_operator": "pixelate"}},
"tiers": {"accelerated_full": {"min_vram_mb": 12288, "requires_cuda": true, "estimated_seconds_per_image": 16.0}},
"weights": {"detector": {"recall": 0.65, "f1": 0.25, "precision": 0.1}}}"""


@query("s10_scan_registry", """SELECT image_id, CASE WHEN view_type = 'egocentric' THEN 'solid_mask' ELSE 'blur' END AS face_operator, CASE WHEN view_type = 'egocentric' THEN 'privacy_first' ELSE 'utility_priority' END AS objective_id FROM frames""")
def _(v):
    path = scratch(v.spark, "registry")
    v.spark.createDataFrame([(REGISTRY,)], "value string").coalesce(1).write.text(path, lineSep="\n\n")
    profiles = S.scan_registry(v.spark, path)["profiles"]
    focus = F.when(C("view_type") == "egocentric", "privacy").otherwise("utility").alias("focus")
    return v.frames.select("image_id", focus).join(F.broadcast(profiles), "focus").select("image_id", "face_operator", "objective_id")


@query("s11_scan_subgroup_files", "SELECT source AS model, count(*) AS boxes, sum(score) AS score FROM cand_boxes GROUP BY source", dbl="score")
def _(v):
    root = scratch(v.spark, "models")
    # a folder per model, all in one pass over the boxes
    parts = v.cand_boxes.select("image_id", *CORNERS, "score", C("source").alias("detector_name"), F.concat("source", F.lit(".csv")).alias("model"))
    parts.write.partitionBy("model").csv(root, header=True)
    rows = S.scan_subgroup_files(v.spark, f"{root}/*.csv")
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("boxes"), F.sum("score").alias("score"))


@query("s12_load_image_features", """SELECT CASE WHEN view_type = 'egocentric' THEN 'stress_500' ELSE 'exocentric' END || '::' || CAST(image_id AS VARCHAR) AS scoped_id, brightness, blur_score AS sharpness, 0.0 AS edge_density, screen_score AS saturation FROM quality_frame""",
       dbl="brightness sharpness edge_density saturation")
def _(v):
    rows = v.quality_frame.select("image_id", C("view_type").alias("protocol"), "brightness", C("blur_score").alias("sharpness"),
                                  F.lit(None).cast("double").alias("edge_density"), C("screen_score").alias("saturation"))
    return S.load_image_features(rows, {"egocentric": "stress_500"})


@query("s13_load_scene_predictions", "SELECT 'p::' || CAST(image_id AS VARCHAR) AS scoped_id, no_face, large_face FROM pred_conditions")
def _(v):
    rows = v.pred_conditions.select("image_id", F.lit("p").alias("protocol"), F.explode(F.array(F.lit("base"), F.lit("hybrid"))).alias("method"),
                                    C("no_face").alias("pred_no_face"), C("large_face").alias("pred_large_face"))
    return S.load_scene_predictions(rows, "hybrid")


@query("s14_split_scoped_id", """SELECT b.pred_id, 'stress' AS protocol, m.relative_path, round(score / 3, 8) AS score, b.source FROM cand_boxes b JOIN manifest m USING (image_id)""", dbl="score")
def _(v):
    rows = v.cand_boxes.join(v.manifest.select("image_id", "relative_path"), "image_id")
    scoped = rows.select("pred_id", F.concat(F.lit("stress::"), C("relative_path")).alias("scoped_id"), (C("score") / 3).alias("score"), C("source").alias("detector_name"))
    return S.split_scoped_id(scoped).select("pred_id", "protocol", "relative_path", "score", "source")


# sinks


def flags(v):
    return v.conditions.select("image_id", "large_face"), v.conditions.filter("no_face = 1").select("image_id", F.lit("empty").alias("note"))


@query("k01_write_union", "SELECT image_id, large_face, CAST(NULL AS VARCHAR) AS note FROM conditions UNION ALL SELECT image_id, NULL, 'empty' FROM conditions WHERE no_face = 1")
def _(v):
    path = scratch(v.spark, "union")
    K.write_union(flags(v), path)
    return v.spark.read.parquet(path)


@query("k02_write_atomic", "SELECT image_id, day_id FROM frames")
def _(v):
    path = scratch(v.spark, "atomic")
    for _ in range(2):
        K.write_atomic(v.frames.select("image_id", "day_id"), path)
    return v.spark.read.parquet(path)


@query("k03_decision_log", "SELECT objective, count(*) AS n FROM (SELECT CASE WHEN large_face = 1 THEN 'privacy_first' ELSE 'balanced' END AS objective FROM conditions) GROUP BY objective")
def _(v):
    path = scratch(v.spark, "decisions")
    K.decision_log(v.conditions.select("image_id", F.when(C("large_face") == 1, "privacy_first").otherwise("balanced").alias("objective")), path)
    return v.spark.read.parquet(path).groupBy("objective").agg(F.count(F.lit(1)).alias("n"))


@query("k04_refresh_cache", "SELECT image_id, CASE WHEN view_type = 'egocentric' AND blur_score >= 100 THEN blur_score ELSE blur_score + 1 END AS blur_score FROM quality_frame", dbl="blur_score")
def _(v):
    rows = v.quality_frame.select("image_id", "view_type", C("blur_score").alias("raw"))
    old = rows.filter(C("view_type") == "egocentric").select("image_id", F.when(C("raw") >= 100, C("raw")).alias("blur_score"), F.lit(1).alias("version"))
    compute = lambda missing: missing.select("image_id", (C("raw") + 1).alias("blur_score"))
    _, done = K.refresh_cache(old, rows, "image_id", ["blur_score"], compute)
    return done.select("image_id", "blur_score")


@query("k05_resume_pairs", "SELECT image_id, method FROM method_metrics WHERE status NOT IN ('ok', 'existing')")
def _(v):
    m = v.method_metrics
    done = m.filter(C("status").isin("ok", "existing"))
    return K.resume_pairs(m.select("image_id", "method"), done, ["image_id", "method"])


@query("k06_partition_by_subgroup", f"SELECT subgroup, count(*) AS n FROM membership WHERE subgroup IN ({', '.join(repr(k) for k in LABELS)}) GROUP BY subgroup")
def _(v):
    path = scratch(v.spark, "subgroups")
    K.partition_by_subgroup(v.conditions.select("image_id", *LABELS), [(k, C(k) == 1) for k in LABELS], path)
    return v.spark.read.parquet(path).groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"))


PLAN = """plan AS MATERIALIZED (SELECT relative_path, CASE WHEN integrity_status = 'valid' THEN size_bytes END AS source_bytes, CASE WHEN integrity_status <> 'valid' THEN 'missing' WHEN view_type = 'exocentric' AND size_bytes % 2 = 0 THEN 'already_present' ELSE 'copy' END AS status FROM manifest)"""


def plan(v):
    m = v.manifest
    parts = [m.filter(C("view_type") == "egocentric"), m]
    target = m.filter(C("view_type") == "exocentric").select("relative_path", F.when(C("size_bytes") % 2 == 0, C("size_bytes")).otherwise(F.lit(0)).alias("size_bytes"))
    return K.copy_plan(parts, m.filter(C("integrity_status") == "valid"), target)


@query("k07_copy_plan", "SELECT * FROM plan", ctes=PLAN)
def _(v):
    return plan(v).drop("target_bytes")


@query("k07_copy_totals", """SELECT count(*) AS requested, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'already_present') AS already_present, sum(source_bytes) AS bytes,
  sum(source_bytes) / 1024.0 / 1024.0 AS mib, sum(source_bytes) / 1024.0 / 1024.0 / 1024.0 AS gib FROM plan""", ctes=PLAN, dbl="mib gib", big="bytes")
def _(v):
    return K.copy_totals(plan(v))


@query("k07_missing_examples", "SELECT relative_path FROM plan WHERE status = 'missing' ORDER BY relative_path LIMIT 20", ctes=PLAN)
def _(v):
    return K.missing_examples(plan(v))


@query("k08_subset_sinks", """SELECT image_id, 'zero_face_false_positives' AS subset FROM audit WHERE zero_face_image AND false_positive_count > 0 UNION ALL SELECT image_id, 'missed_faces' FROM audit WHERE false_negative_count > 0""", ctes=AUDIT)
def _(v):
    parts = K.subset_sinks(M.error_summary(v.pred_boxes, v.gt_boxes, v.frames), v.conditions.select("image_id", "large_face"))
    zero, missed = (parts[k].select("image_id", F.lit(k).alias("subset")) for k in ("zero_face_false_positives", "missed_faces"))
    return zero.unionByName(missed)


@query("k09_split_by_kind", """SELECT b.image_id, 'rfdetr+scrfd+yolo' AS sources, x1, y1, x2, y2, CASE source WHEN 'rfdetr' THEN score WHEN 'scrfd' THEN 1.0 ELSE score END AS score, CASE source WHEN 'rfdetr' THEN 'face' WHEN 'scrfd' THEN 'screen' ELSE 'text' END AS kind FROM cand_boxes b""", dbl="score")
def _(v):
    box = lambda s: F.when(C("source") == s, F.struct(*CORNERS, F.when(C("source") != "scrfd", C("score")).alias("score")))
    # one record per box: three short arrays, as in a detection document
    pack = lambda s: F.array_compact(F.array(box(s)))
    records = v.cand_boxes.select("image_id", F.array(F.lit("rfdetr"), F.lit("scrfd"), F.lit("yolo")).alias("sources"),
                                  pack("rfdetr").alias("faces"), pack("scrfd").alias("screens"), pack("yolo").alias("texts"))
    return K.split_by_kind(records)
