"""Input views over the given tables, once for Spark and once as SQL text.

Every view reads its whole table and uses integer arithmetic on keys, so both
engines produce the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: method ids
METHODS = ("pixelate", "blur", "layered_blur_downscale_noise", "diffusion_low_step", "nullface", "solid_mask_black")
SOURCES = ("rfdetr", "scrfd", "yolo")
# fixed values: condition labels
LABELS = (
    "no_face", "single_face", "multi_face", "small_face", "medium_face", "large_face", "mixed_scale_face",
    "very_small_or_distant_face", "edge_or_partial_face", "profile_or_occluded_face", "downward_egocentric_view",
    "motion_blur_or_low_sharpness", "low_light_or_dim", "high_clutter",
)
# fixed values: hard-condition labels of the sampling stage
HARD_LABELS = (
    "small_face", "motion_blur", "extreme_pose", "downward_view", "visible_screen", "visible_text",
    "multiple_faces", "no_face",
)
WIDTH, HEIGHT = 3840, 2160

_FRAMES = f"""
SELECT o_orderkey AS image_id,
  'day' || CAST(month(o_orderdate) AS VARCHAR) AS day_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'egocentric' ELSE 'exocentric' END AS view_type,
  CASE WHEN o_custkey % 2 = 0 THEN 'p' || CAST(o_custkey % 11 AS VARCHAR)
       WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'kitchen'
       WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'living1'
       WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'living2'
       WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'meeting' ELSE 'reading' END AS camera_stream_id,
  'p' || CAST(o_custkey % 11 AS VARCHAR) AS participant_id,
  lpad(CAST(o_custkey // 2 % 24 AS VARCHAR), 2, '0') || '_' || lpad(CAST(o_orderkey % 720 + 1 AS VARCHAR), 4, '0') AS timestamp_id,
  CAST(CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1920 ELSE {WIDTH} END AS BIGINT) AS width,
  CAST(CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1080 ELSE {HEIGHT} END AS BIGINT) AS height,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CASE WHEN o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '5' THEN 'failed' ELSE 'valid' END AS integrity_status,
  o_custkey AS custkey
FROM orders
"""

_MANIFEST = """
SELECT image_id, day_id, view_type, camera_stream_id, participant_id, timestamp_id, width, height, size_bytes,
  integrity_status, custkey,
  day_id || '/' || CASE WHEN view_type = 'egocentric' THEN 'members' ELSE 'fixed' END || '/' || camera_stream_id || '/'
    || substr(timestamp_id, 1, 2) || '/' || CAST(image_id AS VARCHAR) || '/' || timestamp_id || '.webp' AS relative_path
FROM frames
"""

_GT = """
SELECT l_orderkey AS image_id,
  CAST((l_partkey * 100000 + l_suppkey) * 512 + l_linenumber * 64 + CAST(l_quantity AS BIGINT) AS BIGINT) AS gt_id,
  l_partkey * 37 % 3500 AS x1, l_suppkey * 53 % 1900 AS y1,
  l_partkey * 37 % 3500 + 40 + 4 * CAST(l_quantity AS BIGINT) AS x2,
  l_suppkey * 53 % 1900 + 50 + 4 * CAST(l_quantity AS BIGINT) AS y2
FROM lineitem WHERE l_returnflag <> 'R'
"""

# Each source misses boxes by an attribute of the line: tax, discount or status.
_CAND = """
SELECT l_orderkey AS image_id,
  ((l_partkey * 100000 + l_suppkey) * 512 + l_linenumber * 64 + CAST(l_quantity AS BIGINT)) * 3 + s AS pred_id,
  CASE s WHEN 0 THEN 'rfdetr' WHEN 1 THEN 'scrfd' ELSE 'yolo' END AS source,
  l_partkey * 37 % 3500 + (l_partkey * (s + 3) % 11 - 5) * 6 AS x1,
  l_suppkey * 53 % 1900 + (l_suppkey * (s + 2) % 9 - 4) * 6 AS y1,
  l_partkey * 37 % 3500 + (l_partkey * (s + 3) % 11 - 5) * 6 + 40 + 4 * CAST(l_quantity AS BIGINT) AS x2,
  l_suppkey * 53 % 1900 + (l_suppkey * (s + 2) % 9 - 4) * 6 + 50 + 4 * CAST(l_quantity AS BIGINT) AS y2,
  ((l_partkey * 131 + l_suppkey * 17 + l_linenumber * 7 + s * 311) % 997 + 1) / 1000.0 AS score
FROM lineitem CROSS JOIN (SELECT unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(2 AS BIGINT)]) AS s)
WHERE (s = 0 AND l_tax > 0.005) OR (s = 1 AND l_discount > 0.015) OR (s = 2 AND (l_tax < 0.065 OR l_linestatus = 'O'))
"""

_QUALITY = """
SELECT m.image_id, m.relative_path, m.day_id, m.view_type, m.camera_stream_id, m.participant_id, m.integrity_status, m.size_bytes,
  coalesce(g.face_count, 0) AS face_count, coalesce(g.largest, 0) AS largest_face_size_px, coalesce(g.smallest, 0) AS min_face_size_px,
  (m.custkey * 37 + m.image_id * 11) % 5000 / 10.0 AS blur_score,
  (m.custkey * 29 + m.image_id * 7) % 2560 / 10.0 AS brightness,
  (m.custkey * 13 + m.image_id * 3) % 997 / 10.0 AS webp_blockiness_score,
  (m.custkey * 17 + m.image_id * 5) % 400 / 1000.0 AS screen_score,
  CAST((m.custkey * 7 + m.image_id) % 50 AS DOUBLE) AS text_score,
  CASE WHEN coalesce(g.face_count, 0) > 0 THEN (m.custkey + m.image_id * 3) % 6 / 10.0 ELSE 0.0 END AS occlusion_ratio_value,
  coalesce(g.smallest, 0) > 0 AND coalesce(g.smallest, 0) < 80 AS small_face_flag,
  (m.custkey * 37 + m.image_id * 11) % 5000 < 1250 AS motion_blur_flag,
  coalesce(g.face_count, 0) > 0 AND m.image_id % 13 = 0 AS extreme_pose_flag,
  m.view_type = 'egocentric' AND m.image_id % 9 = 0 AS downward_view_flag,
  (m.custkey * 17 + m.image_id * 5) % 400 >= 320 AS visible_screen_flag,
  (m.custkey * 7 + m.image_id) % 50 >= 30 AS visible_text_flag,
  coalesce(g.face_count, 0) > 1 AS multiple_faces_flag,
  coalesce(g.face_count, 0) = 0 AS no_face_flag
FROM manifest m LEFT JOIN (
  SELECT image_id, count(*) AS face_count, CAST(max(least(x2 - x1, y2 - y1)) AS BIGINT) AS largest,
    CAST(min(least(x2 - x1, y2 - y1)) AS BIGINT) AS smallest FROM gt_boxes GROUP BY image_id) g ON m.image_id = g.image_id
"""

_FLAG_SQL = {
    "no_face": "n = 0",
    "single_face": "n = 1",
    "multi_face": "n >= 2",
    "small_face": "n > 0 AND low < 100",
    "medium_face": "n > 0 AND low < 180 AND high >= 100",
    "large_face": "n > 0 AND high >= 180",
    "mixed_scale_face": "n > 0 AND high >= 2 * low",
    "very_small_or_distant_face": "n > 0 AND low < 60",
    "edge_or_partial_face": "n > 0 AND edge <= 64",
    "profile_or_occluded_face": "n > 0 AND image_id % 7 = 3",
    "downward_egocentric_view": "view_type = 'egocentric' AND image_id % 5 = 0",
    "motion_blur_or_low_sharpness": "(custkey * 37 + image_id * 11) % 5000 < 1250",
    "low_light_or_dim": "(custkey * 29 + image_id * 7) % 2560 < 400",
    "high_clutter": "(custkey * 7 + image_id) % 50 >= 40",
}

_CONDITIONS = f"""
SELECT image_id, relative_path, participant_id, day_id, n AS box_count,
  {', '.join(f"CAST(CASE WHEN {e} THEN 1 ELSE 0 END AS BIGINT) AS {k}" for k, e in _FLAG_SQL.items())}
FROM (SELECT m.*, coalesce(g.n, 0) AS n, coalesce(g.low, 0) AS low, coalesce(g.high, 0) AS high, coalesce(g.edge, 0) AS edge
  FROM manifest m LEFT JOIN (SELECT image_id, count(*) AS n, min(y2 - y1) AS low, max(y2 - y1) AS high, min(x1) AS edge
    FROM gt_boxes GROUP BY image_id) g ON m.image_id = g.image_id)
"""

_PRED_CONDITIONS = f"""
SELECT image_id, relative_path, participant_id, day_id, box_count,
  {', '.join(f"CAST(CASE WHEN (image_id * {i + 3} + {i}) % 11 = 0 THEN 1 - {k} ELSE {k} END AS BIGINT) AS {k}"
             for i, k in enumerate(LABELS))}
FROM conditions
"""

_MEMBERSHIP = "SELECT image_id, 'overall' AS subgroup FROM conditions " + " ".join(
    f"UNION ALL SELECT image_id, '{k}' FROM conditions WHERE {k} = 1" for k in LABELS
)

_METRICS = f"""
SELECT c.image_id, c.participant_id, c.box_count, v.method, v.i AS method_index,
  CASE WHEN (image_id * 5 + i * 7) % 37 = 0 THEN 'failed' WHEN (image_id + i) % 3 = 0 THEN 'existing' ELSE 'ok' END AS status,
  CASE WHEN (image_id * 3 + i * 5) % 31 = 0 THEN NULL ELSE (600 + (image_id * 7 + i * 131) % 400) / 1000.0 END AS ssim,
  CASE WHEN (image_id + i * 3) % 23 = 0 THEN NULL ELSE (image_id * 11 + i * 17) % 60 / 1000.0 END AS lpips,
  CASE WHEN box_count = 0 THEN NULL ELSE (image_id * 13 + i * 29) % (1000 - i * 150) / 1000.0 END AS reid_a,
  CASE WHEN box_count = 0 OR (image_id + i) % 41 = 0 THEN NULL ELSE (image_id * 17 + i * 31) % (1000 - i * 150) / 1000.0 END AS reid_b,
  CASE WHEN box_count = 0 OR (image_id + i) % 43 = 0 THEN NULL ELSE (image_id * 19 + i * 37) % (1000 - i * 150) / 1000.0 END AS reid_c,
  CASE WHEN (image_id + i * 5) % 29 = 0 THEN NULL ELSE (image_id * 3 + i * 53) % 400 / 50.0 END AS runtime_seconds,
  (400 + (image_id * 23 + i * 41) % 600) / 1000.0 AS face_region_utility,
  (700 + (image_id * 29 + i * 43) % 300) / 1000.0 AS background_preservation
FROM conditions c CROSS JOIN (
  {' UNION ALL '.join(f"SELECT '{m}' AS method, CAST({i} AS BIGINT) AS i" for i, m in enumerate(METHODS))}) v
"""

_SCORED = """
SELECT *, CASE WHEN success = 0 THEN 0.0 ELSE least(greatest(0.5 * coalesce(ssim, 0.0) + 0.5 * lpips_term, 0.0), 1.0) END AS utility_score,
  least(greatest(1.0 - runtime_for_score / 5.0, 0.0), 1.0) AS runtime_score
FROM (SELECT *, CASE WHEN success = 0 THEN 0.0 WHEN box_count = 0 THEN 1.0
    ELSE least(greatest(1.0 - (coalesce(reid_a, 0.0) + coalesce(reid_b, 0.0)) / 2, 0.0), 1.0) END AS privacy_score,
  least(greatest(1.0 - coalesce(lpips, 0.05) / 0.05, 0.0), 1.0) AS lpips_term,
  coalesce(runtime_seconds, 30.0) AS runtime_for_score
  FROM (SELECT *, CASE WHEN status IN ('ok', 'existing', 'completed', 'copied') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS success
    FROM method_metrics))
"""

_TEXT_PAIRS = """
SELECT doc_id, CAST(word AS BIGINT) AS word, lang, before, regexp_replace(before, '[aeiou]', '#', 'g') AS after
FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS before, generate_subscripts(string_split(text, ' '), 1) AS word FROM documents)
"""

_PIXELS = """
SELECT vec_id AS image_id, CAST((i - 1) // 8 AS BIGINT) AS row, CAST((i - 1) % 8 AS BIGINT) AS col,
  CAST(floor((embedding[i] + 1) * 127.0) AS BIGINT) AS v
FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)
"""

SQL_VIEWS: dict[str, str] = {
    "frames": _FRAMES, "manifest": _MANIFEST, "gt_boxes": _GT, "cand_boxes": _CAND,
    "pred_boxes": "SELECT image_id, pred_id, source, x1, y1, x2, y2, score FROM cand_boxes WHERE source = 'rfdetr'",
    "quality_frame": _QUALITY, "conditions": _CONDITIONS, "pred_conditions": _PRED_CONDITIONS,
    "membership": _MEMBERSHIP, "method_metrics": _METRICS, "scored_metrics": _SCORED,
    "text_pairs": _TEXT_PAIRS, "pixels": _PIXELS,
}


class Views:
    """The same views as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        c, priority = F.col, F.substring("o_orderpriority", 1, 1)
        ego = c("o_custkey") % 2 == 0
        small = (c("o_orderstatus") == "P") & priority.isin("1", "2")
        exo_stream = (
            F.when(priority == "1", "kitchen").when(priority == "2", "living1").when(priority == "3", "living2")
            .when(priority == "4", "meeting").otherwise("reading"))
        person = F.concat(F.lit("p"), (c("o_custkey") % 11).cast("string"))
        return self.table("orders").select(
            c("o_orderkey").alias("image_id"),
            F.concat(F.lit("day"), F.month("o_orderdate").cast("string")).alias("day_id"),
            F.when(ego, "egocentric").otherwise("exocentric").alias("view_type"),
            F.when(ego, person).otherwise(exo_stream).alias("camera_stream_id"),
            person.alias("participant_id"),
            F.concat(F.lpad((F.floor(c("o_custkey") / 2) % 24).cast("string"), 2, "0"), F.lit("_"),
                     F.lpad((c("o_orderkey") % 720 + 1).cast("string"), 4, "0")).alias("timestamp_id"),
            F.when(small, 1920).otherwise(WIDTH).cast("bigint").alias("width"),
            F.when(small, 1080).otherwise(HEIGHT).cast("bigint").alias("height"),
            F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
            F.when((c("o_orderstatus") == "P") & (priority == "5"), "failed").otherwise("valid").alias("integrity_status"),
            c("o_custkey").alias("custkey"))

    @cached_property
    def manifest(self) -> DataFrame:
        kind = F.when(F.col("view_type") == "egocentric", "members").otherwise("fixed")
        stem = F.concat(F.col("timestamp_id"), F.lit(".webp"))
        return self.frames.withColumn("relative_path", F.concat_ws(
            "/", "day_id", kind, "camera_stream_id", F.substring("timestamp_id", 1, 2),
            F.col("image_id").cast("string"), stem))

    @staticmethod
    def _row_id():
        c = F.col
        return ((c("l_partkey") * 100000 + c("l_suppkey")) * 512 + c("l_linenumber") * 64
                + c("l_quantity").cast("bigint"))

    @cached_property
    def gt_boxes(self) -> DataFrame:
        c = F.col
        x, y, q = c("l_partkey") * 37 % 3500, c("l_suppkey") * 53 % 1900, c("l_quantity").cast("bigint")
        return self.table("lineitem").filter(c("l_returnflag") != "R").select(
            c("l_orderkey").alias("image_id"), self._row_id().alias("gt_id"), x.alias("x1"), y.alias("y1"),
            (x + 40 + 4 * q).alias("x2"), (y + 50 + 4 * q).alias("y2"))

    @cached_property
    def cand_boxes(self) -> DataFrame:
        c = F.col
        rows = self.table("lineitem").withColumn("s", F.explode(F.expr("array(0L, 1L, 2L)")))
        s = c("s")
        seen = (((s == 0) & (c("l_tax") > 0.005)) | ((s == 1) & (c("l_discount") > 0.015))
                | ((s == 2) & ((c("l_tax") < 0.065) | (c("l_linestatus") == "O"))))
        x = c("l_partkey") * 37 % 3500 + (c("l_partkey") * (s + 3) % 11 - 5) * 6
        y = c("l_suppkey") * 53 % 1900 + (c("l_suppkey") * (s + 2) % 9 - 4) * 6
        q = c("l_quantity").cast("bigint")
        score = (c("l_partkey") * 131 + c("l_suppkey") * 17 + c("l_linenumber") * 7 + s * 311) % 997 + 1
        return rows.filter(seen).select(
            c("l_orderkey").alias("image_id"), (self._row_id() * 3 + s).alias("pred_id"),
            F.when(s == 0, "rfdetr").when(s == 1, "scrfd").otherwise("yolo").alias("source"),
            x.alias("x1"), y.alias("y1"), (x + 40 + 4 * q).alias("x2"), (y + 50 + 4 * q).alias("y2"),
            (score / F.lit(1000.0)).alias("score"))

    @cached_property
    def pred_boxes(self) -> DataFrame:
        return self.cand_boxes.filter(F.col("source") == "rfdetr")

    @cached_property
    def _faces(self) -> DataFrame:
        short, tall = F.expr("least(x2 - x1, y2 - y1)"), F.expr("y2 - y1")
        return self.gt_boxes.groupBy("image_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(short).alias("largest"), F.min(short).alias("smallest"),
            F.min(tall).alias("low"), F.max(tall).alias("high"), F.min("x1").alias("edge"))

    @cached_property
    def quality_frame(self) -> DataFrame:
        m = self.manifest.join(self._faces, "image_id", "left").fillna(0, ["n", "largest", "smallest"])
        c, k, i = F.col, F.col("custkey"), F.col("image_id")
        blur, screen, text = (k * 37 + i * 11) % 5000, (k * 17 + i * 5) % 400, (k * 7 + i) % 50
        return m.select(
            "image_id", "relative_path", "day_id", "view_type", "camera_stream_id", "participant_id", "integrity_status",
            "size_bytes", c("n").alias("face_count"), c("largest").alias("largest_face_size_px"),
            c("smallest").alias("min_face_size_px"), (blur / F.lit(10.0)).alias("blur_score"),
            ((k * 29 + i * 7) % 2560 / F.lit(10.0)).alias("brightness"),
            ((k * 13 + i * 3) % 997 / F.lit(10.0)).alias("webp_blockiness_score"),
            (screen / F.lit(1000.0)).alias("screen_score"), text.cast("double").alias("text_score"),
            F.when(c("n") > 0, (k + i * 3) % 6 / F.lit(10.0)).otherwise(F.lit(0.0)).alias("occlusion_ratio_value"),
            ((c("smallest") > 0) & (c("smallest") < 80)).alias("small_face_flag"), (blur < 1250).alias("motion_blur_flag"),
            ((c("n") > 0) & (i % 13 == 0)).alias("extreme_pose_flag"),
            ((c("view_type") == "egocentric") & (i % 9 == 0)).alias("downward_view_flag"),
            (screen >= 320).alias("visible_screen_flag"), (text >= 30).alias("visible_text_flag"),
            (c("n") > 1).alias("multiple_faces_flag"), (c("n") == 0).alias("no_face_flag"))

    @cached_property
    def conditions(self) -> DataFrame:
        m = self.manifest.join(self._faces, "image_id", "left").fillna(0, ["n", "low", "high", "edge"])
        return m.select(
            "image_id", "relative_path", "participant_id", "day_id", F.col("n").alias("box_count"),
            *[F.expr(f"CAST(CASE WHEN {e} THEN 1 ELSE 0 END AS BIGINT)").alias(k) for k, e in _FLAG_SQL.items()])

    @cached_property
    def pred_conditions(self) -> DataFrame:
        flips = {k: (F.col("image_id") * (i + 3) + i) % 11 == 0 for i, k in enumerate(LABELS)}
        return self.conditions.withColumns(
            {k: F.when(flip, 1 - F.col(k)).otherwise(F.col(k)) for k, flip in flips.items()})

    @cached_property
    def membership(self) -> DataFrame:
        groups = F.array(F.lit("overall"), *[F.when(F.col(k) == 1, F.lit(k)) for k in LABELS])
        return self.conditions.select("image_id", F.explode(F.array_compact(groups)).alias("subgroup"))

    @cached_property
    def method_metrics(self) -> DataFrame:
        k, i, c = F.col("image_id"), F.col("i"), F.col
        methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(n).cast("bigint").alias("i"))
                            for n, m in enumerate(METHODS)])
        rows = self.conditions.select("image_id", "participant_id", "box_count", F.inline(methods))
        faceless, span = c("box_count") == 0, 1000 - i * 150
        some = lambda hole, value: F.when(~hole, value)
        return rows.select(
            "image_id", "participant_id", "box_count", "method", i.alias("method_index"),
            F.when((k * 5 + i * 7) % 37 == 0, "failed").when((k + i) % 3 == 0, "existing").otherwise("ok").alias("status"),
            some((k * 3 + i * 5) % 31 == 0, (600 + (k * 7 + i * 131) % 400) / F.lit(1000.0)).alias("ssim"),
            some((k + i * 3) % 23 == 0, (k * 11 + i * 17) % 60 / F.lit(1000.0)).alias("lpips"),
            some(faceless, (k * 13 + i * 29) % span / F.lit(1000.0)).alias("reid_a"),
            some(faceless | ((k + i) % 41 == 0), (k * 17 + i * 31) % span / F.lit(1000.0)).alias("reid_b"),
            some(faceless | ((k + i) % 43 == 0), (k * 19 + i * 37) % span / F.lit(1000.0)).alias("reid_c"),
            some((k + i * 5) % 29 == 0, (k * 3 + i * 53) % 400 / F.lit(50.0)).alias("runtime_seconds"),
            ((400 + (k * 23 + i * 41) % 600) / F.lit(1000.0)).alias("face_region_utility"),
            ((700 + (k * 29 + i * 43) % 300) / F.lit(1000.0)).alias("background_preservation"))

    @cached_property
    def scored_metrics(self) -> DataFrame:
        from frameops.operators.policy import score_methods  # views feed the operators

        return score_methods(self.method_metrics)

    @cached_property
    def text_pairs(self) -> DataFrame:
        """Every word of every document as a recognised text region, before and after masking."""
        words = self.table("documents").select("doc_id", "lang", F.posexplode(F.split("text", " ")).alias("pos", "before"))
        return words.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("word"), "lang", "before",
                            F.regexp_replace("before", "[aeiou]", "#").alias("after"))

    @cached_property
    def pixels(self) -> DataFrame:
        cells = self.table("embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding"))
        # in single precision, as the components are stored: a double lands on the other side of some whole numbers
        one, scale = F.lit(1).cast("float"), F.lit(127).cast("float")
        return cells.select(
            "image_id", F.floor(F.col("pos") / 8).alias("row"), (F.col("pos") % 8).cast("bigint").alias("col_"),
            F.floor((F.col("col") + one) * scale).alias("v")).withColumnRenamed("col_", "col")
