"""Queries on deterministic sampling and splits (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.functions import labels as L
from frameops.operators import joins as J
from frameops.operators import sampling as P
from frameops.plans.registry import query
from frameops.plans.table_queries import PAIRS
from frameops.plans.views import HARD_LABELS

C = F.col
H = "substr(sha256('42:' || {0}), 1, 16)"
PATH_HASH = H.format("relative_path")
STRATA = ["day_id", "view_type"]


def sample_ctes(source: str, n: int, strata: str = "day_id, view_type", key: str = "relative_path", p: str = "") -> str:
    on = " AND ".join(f"r.{s.strip()} IS NOT DISTINCT FROM q.{s.strip()}" for s in strata.split(","))
    return f"""
{p}sizes AS (SELECT {strata}, count(*) AS size FROM {source} GROUP BY {strata}),
{p}floors AS (SELECT *, CAST(size * {n} AS DOUBLE) / (SELECT sum(size) FROM {p}sizes) AS exact FROM {p}sizes),
{p}quota AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, {strata}) <= {n} - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {p}floors),
{p}sample AS MATERIALIZED (SELECT r.* EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {H.format(key)}, {key}) AS rk FROM {source}) r JOIN {p}quota q ON {on} WHERE r.rk <= q.quota)"""


@query("p01_stable_order", f"SELECT image_id, {PATH_HASH} AS stable_order FROM manifest")
def _(v):
    return v.manifest.select("image_id", L.stable_order(42, C("relative_path")).alias("stable_order"))


@query("p02_stratified_sample", "SELECT image_id, day_id, view_type FROM sample", ctes=sample_ctes("manifest", 1000))
def _(v):
    return P.stratified_sample(v.manifest, "relative_path", STRATA, 1000).select("image_id", "day_id", "view_type")


@query("p03_one_per_group", f"SELECT day_id, camera_stream_id, arg_min(image_id, {{'h': {PATH_HASH}, 'k': relative_path}}) AS image_id FROM manifest GROUP BY ALL")
def _(v):
    return P.one_per_group(v.manifest, "relative_path", ["day_id", "camera_stream_id"]).select("day_id", "camera_stream_id", "image_id")


FIRST = f"firsts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day_id, camera_stream_id ORDER BY {PATH_HASH}, relative_path) = 1 AS anchor FROM manifest)"


@query("p04_anchored_pool", f"""SELECT image_id FROM firsts WHERE anchor UNION ALL SELECT image_id FROM (SELECT image_id FROM firsts WHERE NOT anchor ORDER BY {PATH_HASH}, relative_path
  LIMIT 800 - (SELECT count(*) FROM firsts WHERE anchor))""", ctes=FIRST)
def _(v):
    return P.anchored_pool(v.manifest, "relative_path", ["day_id", "camera_stream_id"], 800).select("image_id")


@query("p05_diverse_pool", f"""SELECT image_id FROM twos WHERE rk <= 2 UNION ALL SELECT image_id FROM (SELECT image_id FROM twos WHERE rk > 2
  ORDER BY {H.format("(day_id || '|' || camera_stream_id || '|' || view_type)")}, {PATH_HASH}, relative_path LIMIT 900 - (SELECT count(*) FROM twos WHERE rk <= 2))""",
       ctes="twos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day_id, camera_stream_id, view_type ORDER BY relative_path) AS rk FROM manifest)")
def _(v):
    return P.diverse_pool(v.manifest, "relative_path", ["day_id", "camera_stream_id", "view_type"], 900).select("image_id")


@query("p06_cell_sample", f"""SELECT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY motion_blur_flag, visible_text_flag, view_type, day_id ORDER BY {PATH_HASH}, relative_path) <= 3 AS head, {PATH_HASH} AS h, relative_path
  FROM quality_frame WHERE face_count > 0) ORDER BY head DESC, h, relative_path LIMIT 400""")
def _(v):
    faces = v.quality_frame.filter(C("face_count") > 0)
    return P.cell_sample(faces, "relative_path", ["motion_blur_flag", "visible_text_flag", "view_type", "day_id"], 3, 400).select("image_id")


def quota_ctes(k: int, n: int) -> str:
    """Each label in turn takes its first unused rows; the rest follows by tier."""
    ctes = [f"""qf AS MATERIALIZED (SELECT image_id, relative_path, no_face_flag, {PATH_HASH} AS h, list_filter([{', '.join(f"CASE WHEN {c} THEN '{lab}' END" for lab, c in L.CONDITION_FLAGS)}], lambda x: x IS NOT NULL) AS m,
  row_number() OVER (PARTITION BY day_id, camera_stream_id ORDER BY {PATH_HASH}, relative_path) = 1 AS anchor FROM quality_frame)"""]
    used = "SELECT NULL AS image_id WHERE FALSE"
    for i, label in enumerate(HARD_LABELS):
        ctes.append(f"""l{i} AS MATERIALIZED (SELECT image_id, '{label}' AS condition_label FROM qf WHERE list_contains(m, '{label}') AND image_id NOT IN (SELECT image_id FROM ({used}) WHERE image_id IS NOT NULL) ORDER BY h, relative_path LIMIT {k})""")
        used += f" UNION ALL SELECT image_id FROM l{i}"
    ctes.append("taken AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(HARD_LABELS))) + ")")
    ctes.append(f"""filler AS MATERIALIZED (SELECT image_id, coalesce(m[1], CASE WHEN no_face_flag THEN 'no_face' END, 'motion_blur') AS condition_label FROM qf WHERE image_id NOT IN (SELECT image_id FROM taken)
  ORDER BY CASE WHEN anchor THEN 0 WHEN len(m) > 0 THEN 1 ELSE 2 END, h, relative_path LIMIT {n} - (SELECT count(*) FROM taken))""")
    return ",\n".join(ctes)


@query("p07_condition_quota", "SELECT image_id, condition_label FROM taken UNION ALL SELECT * FROM filler", ctes=quota_ctes(30, 600))
def _(v):
    rows = v.quality_frame.withColumn("condition_matches", L.condition_membership())
    out = P.condition_quota(rows, "relative_path", "condition_matches", HARD_LABELS, 30, 600, ["day_id", "camera_stream_id"])
    return out.join(rows.select("relative_path", "image_id"), "relative_path").select("image_id", "condition_label")


SCORES = {
    "small_face": "CASE WHEN face_count <= 0 THEN -1.0 ELSE CASE WHEN small_face_flag THEN 1000.0 ELSE 0.0 END + greatest(0.0, 80.0 - min_face_size_px) END",
    "motion_blur": "-blur_score + face_count * 25.0",
    "extreme_pose": "CASE WHEN extreme_pose_flag THEN 1000.0 ELSE 0.0 END + occlusion_ratio_value * 10.0",
    "downward_view": "CASE WHEN downward_view_flag THEN 1000.0 ELSE 0.0 END + largest_face_size_px / 10.0",
    "visible_screen": "screen_score * 100.0 + text_score * 0.35 + CASE WHEN camera_stream_id IN ('meeting', 'reading') THEN 6.0 WHEN camera_stream_id IN ('living1', 'living2') THEN -8.0 ELSE 0.0 END",
    "visible_text": "text_score * 3.0 + least(blur_score / 150.0, 10.0) - screen_score * 10.0",
    "multiple_faces": "CAST(face_count AS DOUBLE)",
    "no_face": "CASE WHEN no_face_flag THEN 1000.0 ELSE 0.0 END - screen_score * 20.0 - text_score + least(blur_score / 200.0, 5.0)",
}


@query("p08_condition_score", "SELECT image_id, " + ", ".join(f"{e} AS {k}" for k, e in SCORES.items()) + " FROM quality_frame", dbl=" ".join(SCORES))
def _(v):
    return v.quality_frame.select("image_id", *[L.condition_score(k).alias(k) for k in SCORES])


BANK = """pool AS MATERIALIZED (SELECT image_id, day_id || '|' || camera_stream_id AS key, round(text_score * 3.0 + least(blur_score / 150.0, 10.0) - screen_score * 10.0, 9) AS s, {h} AS h, relative_path
  FROM quality_frame WHERE visible_text_flag AND NOT motion_blur_flag AND text_score >= 12),
ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, h, relative_path) AS rk, row_number() OVER (PARTITION BY key ORDER BY s DESC, h, relative_path) = 1 AS is_first FROM pool),
cutoff AS (SELECT CASE WHEN count(*) = 25 THEN max(rk) END AS c FROM (SELECT rk FROM ranked WHERE is_first ORDER BY rk LIMIT 25)),
phased AS (SELECT *, CASE WHEN (c IS NULL OR rk <= c) AND is_first THEN 1 WHEN c IS NULL OR rk <= c THEN 3 ELSE 2 END AS phase FROM ranked CROSS JOIN cutoff),
bank AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY s DESC) AS d FROM (SELECT * FROM phased ORDER BY phase, rk LIMIT 50))""".format(h=PATH_HASH)


@query("p09_candidate_bank", "SELECT image_id, s AS candidate_score, round(CAST(d AS DOUBLE) / max(d) OVER (), 3) AS label_confidence FROM bank", ctes=BANK, dbl="candidate_score label_confidence")
def _(v):
    return P.candidate_bank(v.quality_frame, "relative_path", "visible_text").select("image_id", "candidate_score", "label_confidence")


@query("p10_quality_bank", """SELECT image_id, face_size AS target_quality_value, place FROM (SELECT image_id, face_size, row_number() OVER (PARTITION BY face_size ORDER BY """ + H.format("'face_size:' || face_size || ':' || relative_path") + """, relative_path) AS place
  FROM (SELECT *, CASE WHEN largest_face_size_px <= 0 THEN 'none' WHEN largest_face_size_px < 30 THEN 'small' WHEN largest_face_size_px < 80 THEN 'medium' ELSE 'large' END AS face_size FROM quality_frame)) WHERE place <= 20""")
def _(v):
    rows = v.quality_frame.withColumn("face_size", L.face_size_bucket(C("largest_face_size_px")))
    return P.quality_bank(rows, "relative_path", "face_size", ["none", "small", "medium", "large"], 20).select("image_id", "target_quality_value", "place")


@query("p11_face_priority_seed", """SELECT image_id, p AS face_priority_score FROM (SELECT image_id, face_count * 5.0 + largest_face_size_px AS p, relative_path FROM quality_frame ORDER BY p DESC, relative_path LIMIT 500)""", dbl="face_priority_score")
def _(v):
    return P.face_priority_seed(v.quality_frame, "relative_path", "small_face", 50).select("image_id", "face_priority_score")


@query("p12_overlay", "SELECT image_id, CASE WHEN large_face = 1 THEN 'review' ELSE 'model' END AS origin FROM conditions")
def _(v):
    primary = v.conditions.filter("large_face = 1").select("image_id", F.lit("review").alias("origin"))
    return P.overlay(primary, v.conditions.select("image_id", F.lit("model").alias("origin")), "image_id")


@query("p13_exclude_overlap", "SELECT image_id FROM conditions WHERE large_face = 0 AND no_face = 0")
def _(v):
    c = v.conditions
    return P.exclude_overlap(c.select("image_id"), "image_id", c.filter("large_face = 1"), c.filter("no_face = 1"))


CHAIN = sample_ctes("manifest", 600, p="a_") + """,
left_over AS MATERIALIZED (SELECT * FROM manifest WHERE relative_path NOT IN (SELECT relative_path FROM a_sample)),""" + sample_ctes("left_over", 500, p="b_")


@query("p14_chained_subsets", "SELECT image_id, 'detection' AS subset FROM a_sample UNION ALL SELECT image_id, 'anonymisation' FROM b_sample", ctes=CHAIN)
def _(v):
    spec = [{"name": "detection", "n": 600, "strata": STRATA}, {"name": "anonymisation", "n": 500, "strata": STRATA}]
    return P.chained_subsets(v.manifest, "relative_path", spec).select("image_id", "subset")


@query("p15_large_sample", "SELECT image_id FROM b_sample", ctes=CHAIN)
def _(v):
    locked = P.stratified_sample(v.manifest, "relative_path", STRATA, 600)
    return P.large_sample(v.manifest, "relative_path", STRATA, 500, [locked]).select("image_id")


@query("p16_balanced_protocol_sample", f"""SELECT image_id, view_type FROM prot WHERE rk <= 350 UNION ALL SELECT image_id, view_type FROM (SELECT * FROM prot WHERE rk > 350 ORDER BY {PATH_HASH}, relative_path LIMIT 1)""",
       ctes=f"prot AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view_type ORDER BY {PATH_HASH}, relative_path) AS rk FROM manifest)")
def _(v):
    return P.balanced_protocol_sample(v.manifest, "relative_path", "view_type", 701).select("image_id", "view_type")


FOLDS = """fold_sizes AS (SELECT participant_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, participant_id) AS rk FROM {src} GROUP BY participant_id),
rec_fold AS (SELECT CAST(0 AS BIGINT) AS rk, CAST(NULL AS VARCHAR) AS participant_id, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS fold
  UNION ALL SELECT s.rk, s.participant_id, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + s.n ELSE x END), CAST(list_position(r.loads, list_min(r.loads)) AS BIGINT)
  FROM rec_fold r JOIN fold_sizes s ON s.rk = r.rk + 1),
folds AS MATERIALIZED (SELECT participant_id, fold FROM rec_fold WHERE rk > 0)"""


@query("p17_group_kfold", "SELECT image_id, participant_id, fold FROM frames JOIN folds USING (participant_id)", ctes=FOLDS.format(src="frames"))
def _(v):
    return P.group_kfold(v.frames.select("image_id", "participant_id"), "participant_id")


@query("p18_stratified_kfold", f"SELECT image_id, row_number() OVER (PARTITION BY high_clutter ORDER BY {H.format('CAST(image_id AS VARCHAR)')}, image_id) % 5 + 1 AS fold FROM conditions")
def _(v):
    return P.stratified_kfold(v.conditions.select("image_id", "high_clutter"), "image_id", "high_clutter").select("image_id", "fold")


@query("p19_split_half", f"""SELECT vec_id, CASE WHEN rk <= n // 2 THEN 'reference' ELSE 'comparison' END AS half FROM (SELECT vec_id, row_number() OVER (ORDER BY {H.format('CAST(vec_id AS VARCHAR)')}, vec_id) AS rk, count(*) OVER () AS n FROM embeddings) WHERE rk <= 2 * (n // 2)""")
def _(v):
    return P.split_half(v.table("embeddings").select("vec_id"), "vec_id")


@query("p20_pair_sample", "SELECT egocentric_image_id, exocentric_image_id, pair_id FROM sample",
       ctes=PAIRS + ", idpairs AS MATERIALIZED (SELECT *, sha256(egocentric_relative_path || '|' || exocentric_relative_path) AS pair_id FROM xpairs)," +
       sample_ctes("idpairs", 40, "day_id, exocentric_stream_id", "pair_id"))
def _(v):
    return P.pair_sample(J.cross_view_pairs(v.manifest), 40).select("egocentric_image_id", "exocentric_image_id", "pair_id")


@query("p21_source_group", "SELECT image_id, day_id || '/' || camera_stream_id || '/' || substr(timestamp_id, 1, 2) AS source_group FROM manifest")
def _(v):
    return v.manifest.select("image_id", L.source_group(C("relative_path")).alias("source_group"))


VARIANTS = """variants AS MATERIALIZED (SELECT CASE WHEN x.box_count > 2 THEN 'text' ELSE 'screen' END AS modality, x.method AS variant, CASE WHEN f.view_type = 'egocentric' THEN 'development' ELSE 'test' END AS split, avg(x.ssim) AS score
  FROM method_metrics x JOIN frames f USING (image_id) GROUP BY ALL)"""


def variants(v):
    rows = v.method_metrics.join(v.frames.select("image_id", "view_type"), "image_id")
    return rows.groupBy(F.when(C("box_count") > 2, "text").otherwise("screen").alias("modality"), C("method").alias("variant"),
                        F.when(C("view_type") == "egocentric", "development").otherwise("test").alias("split")).agg(F.avg("ssim").alias("score"))


@query("p22_lock_variant", "SELECT modality, variant, split, score FROM variants WHERE split = 'development' AND variant = 'blur'", ctes=VARIANTS, dbl="score")
def _(v):
    return P.lock_variant(variants(v), "score", locked="blur")


@query("p22_select_variant", "SELECT modality, arg_max(variant, {'s': score, 'v': variant}) AS variant FROM variants WHERE split = 'development' GROUP BY modality", ctes=VARIANTS)
def _(v):
    return P.lock_variant(variants(v), "score").select("modality", "variant")


