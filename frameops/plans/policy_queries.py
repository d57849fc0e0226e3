"""Queries on scores, gates, selection, routing and comparison (D, C, and A/E operators that belong to them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameops.functions import labels as L
from frameops.lineage import cut
from frameops.operators import policy as D
from frameops.operators import reconstructed as R
from frameops.operators import stats as S

from frameops.plans.box_queries import SUBGROUP, subgroup_scores
from frameops.plans.expression_queries import CATEGORY_SQL
from frameops.plans.registry import query
from frameops.plans.sample_queries import FOLDS


C = F.col

ENH = """enh AS MATERIALIZED (SELECT *, 0.50 * privacy3 + 0.30 * utility3 + 0.10 * runtime_constrained + 0.10 * success AS enhanced_score,
  0.50 * privacy3 + 0.35 * utility3 + 0.05 * runtime_high_compute + 0.10 * success AS high_compute_score FROM (
  SELECT *, CASE WHEN success = 0 THEN 0.0 WHEN box_count = 0 THEN 1.0 ELSE 1.0 - (coalesce(reid_a, 0) + coalesce(reid_b, 0) + coalesce(reid_c, 0)) / nullif((reid_a IS NOT NULL)::INT + (reid_b IS NOT NULL)::INT + (reid_c IS NOT NULL)::INT, 0) END AS privacy3,
    CASE WHEN success = 0 THEN 0.0 WHEN box_count > 0 THEN 0.40 * utility_score + 0.50 * face_region_utility + 0.10 * background_preservation ELSE utility_score END AS utility3,
    exp(-coalesce(runtime_seconds, 150.0) / 5.0) AS runtime_constrained, least(greatest(1.0 - ln(1 + coalesce(runtime_seconds, 150.0)) / ln(151.0), 0.0), 1.0) AS runtime_high_compute FROM scored_metrics))"""


def enhanced(v):
    return D.enhance_scores(v.method_metrics)


@query("d01_weighted_score", "SELECT image_id, method, 0.4 * privacy_score + 0.3 * utility_score + 0.2 * runtime_score + 0.1 * success AS score FROM scored_metrics", dbl="score")
def _(v):
    weights = {"privacy_score": 0.4, "utility_score": 0.3, "runtime_score": 0.2, "success": 0.1}
    return v.scored_metrics.select("image_id", "method", D.weighted_score(weights).alias("score"))


@query("d02_privacy_score", "SELECT image_id, method, privacy_score FROM scored_metrics", dbl="privacy_score")
def _(v):
    return v.scored_metrics.select("image_id", "method", "privacy_score")


@query("d03_privacy_max", "SELECT image_id, method, 1.0 - greatest(coalesce(reid_a, 0.0), coalesce(reid_b, 0.0)) AS privacy FROM method_metrics", dbl="privacy")
def _(v):
    return v.method_metrics.select("image_id", "method", D.privacy_max().alias("privacy"))


@query("d04_utility_score", "SELECT image_id, method, utility_score FROM scored_metrics", dbl="utility_score")
def _(v):
    return v.scored_metrics.select("image_id", "method", "utility_score")


@query("d05_enhanced_utility", "SELECT image_id, method, utility3 AS utility FROM enh", ctes=ENH, dbl="utility")
def _(v):
    return enhanced(v).select("image_id", "method", C("utility3").alias("utility"))


@query("d06_runtime_score", "SELECT image_id, method, runtime_score AS linear, runtime_constrained AS exponential, runtime_high_compute AS logarithmic FROM enh", ctes=ENH, dbl="linear exponential logarithmic")
def _(v):
    return v.method_metrics.select("image_id", "method", *[D.runtime_score(k).alias(n) for k, n in (("linear", "linear"), ("exponential", "exponential"), ("log", "logarithmic"))])


OBJ = "obj AS MATERIALIZED (SELECT *, " + ", ".join(
    f"least(greatest({w[0]} * privacy_score + {w[1]} * utility_score + {w[2]} * runtime_score + {w[3]} * success, 0.0), 1.0) AS {k}" for k, w in D.OBJECTIVE_WEIGHTS.items()) + " FROM scored_metrics)"
OBJ_COLS = " ".join(D.OBJECTIVE_WEIGHTS)


@query("d07_objective_scores", "SELECT image_id, method, " + ", ".join(D.OBJECTIVE_WEIGHTS) + " FROM obj", ctes=OBJ, dbl=OBJ_COLS)
def _(v):
    return D.objective_scores(v.scored_metrics).select("image_id", "method", *D.OBJECTIVE_WEIGHTS)


@query("d08_f2_deploy_score", """SELECT source, subgroup, CASE WHEN zero_face_specificity IS NOT NULL THEN 0.55 * recall + 0.25 * f2 + 0.10 * precision + 0.10 * zero_face_specificity ELSE 0.65 * recall + 0.25 * f2 + 0.10 * precision END AS score
FROM (SELECT *, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM sub_scores)""", ctes=SUBGROUP, dbl="score")
def _(v):
    return subgroup_scores(v).select("source", "subgroup", D.f2_deploy_score(C("precision"), C("recall"), C("zero_face_specificity")).alias("score"))


@query("d09_mm_detection_score", "SELECT image_id, method, 0.40 * ssim + 0.25 * reid_a + 0.15 * face_region_utility + 0.10 * background_preservation + 0.10 * success AS score FROM scored_metrics", dbl="score")
def _(v):
    return v.scored_metrics.select("image_id", "method", D.mm_detection_score(C("ssim"), C("reid_a"), C("face_region_utility"), C("background_preservation"), C("success")).alias("score"))


MODAL = """modal AS MATERIALIZED (SELECT q.image_id, f.width % 1000 // 800 + (q.text_score >= 30)::INT AS gt_text, (q.text_score >= 25)::INT AS pred_text, (q.screen_score >= 0.2)::INT * 2 AS gt_screen, (q.screen_score >= 0.25)::INT AS pred_screen,
  q.blur_score / 500.0 AS ocr_suppression, q.brightness / 256.0 AS text_obscuration, 1 - q.screen_score AS screen_obscuration FROM quality_frame q JOIN frames f USING (image_id)),
modal_p AS MATERIALIZED (SELECT *, CASE WHEN gt_text > 0 THEN CASE WHEN pred_text = 0 THEN 0.0 ELSE 0.70 * ocr_suppression + 0.30 * text_obscuration END END AS text_privacy,
  CASE WHEN gt_screen > 0 THEN CASE WHEN pred_screen = 0 THEN 0.0 ELSE 0.80 * screen_obscuration + 0.20 * least(1.0, CAST(pred_screen AS DOUBLE) / greatest(1, gt_screen)) END END AS screen_privacy FROM modal)"""


def modal(v):
    q = v.quality_frame.join(v.frames.select("image_id", "width"), "image_id")
    b = lambda e: e.cast("int")
    return q.select("image_id", (F.floor(C("width") % 1000 / 800) + b(C("text_score") >= 30)).alias("gt_text"), b(C("text_score") >= 25).alias("pred_text"),
                    (b(C("screen_score") >= 0.2) * 2).alias("gt_screen"), b(C("screen_score") >= 0.25).alias("pred_screen"), (C("blur_score") / 500.0).alias("ocr_suppression"),
                    (C("brightness") / 256.0).alias("text_obscuration"), (1 - C("screen_score")).alias("screen_obscuration"))


@query("d10_modality_privacy", """SELECT image_id, text_privacy, screen_privacy, CASE WHEN text_privacy IS NULL AND screen_privacy IS NULL THEN NULL
  ELSE (coalesce(text_privacy, 0) + coalesce(screen_privacy, 0)) / ((text_privacy IS NOT NULL)::INT + (screen_privacy IS NOT NULL)::INT) END AS multimodal_privacy FROM modal_p""", ctes=MODAL, dbl="text_privacy screen_privacy multimodal_privacy")
def _(v):
    return D.modality_privacy(modal(v)).select("image_id", "text_privacy", "screen_privacy", "multimodal_privacy")


def member(v):
    return v.membership.filter(C("subgroup") != "overall").select("image_id", C("subgroup").alias("category"))


MEANS = {"success_rate": "success", "ssim_mean": "ssim", "lpips_mean": "lpips", "privacy_mean": "privacy_score", "utility_mean": "utility_score", "runtime_score_mean": "runtime_score",
         "runtime_mean": "runtime_for_score", **{k: k for k in D.OBJECTIVE_WEIGHTS}}
CATS = OBJ + """,
cat_frames AS (SELECT subgroup AS category, count(*) AS support_count, count(*) FILTER (subgroup = 'no_face' OR box_count > 0) AS scored_frame_count FROM membership JOIN conditions USING (image_id) WHERE subgroup <> 'overall' GROUP BY subgroup),
cats AS MATERIALIZED (SELECT g.subgroup AS category, o.method, count(*) AS rows, """ + ", ".join(f"avg({x}) AS {k}" for k, x in MEANS.items()) + """, any_value(f.support_count) AS support_count, any_value(f.scored_frame_count) AS scored_frame_count
  FROM membership g JOIN obj o USING (image_id) JOIN cat_frames f ON f.category = g.subgroup WHERE g.subgroup <> 'overall' AND (g.subgroup = 'no_face' OR o.box_count > 0) GROUP BY g.subgroup, o.method)"""


def cats(v):
    return D.category_scores(D.objective_scores(v.scored_metrics), member(v))


@query("a11_category_scores", "SELECT * FROM cats", ctes=CATS, dbl=" ".join(MEANS))
def _(v):
    return cats(v)


WIN = ", ".join(f"arg_min(method, {{'s': -{k}, 'm': method}}) AS {k.replace('_score', '_method')}" for k in D.OBJECTIVE_WEIGHTS)
WIN_OUT = ", ".join(f"CASE WHEN category = 'no_face' THEN 'no_face_copy_or_multimodal_only' ELSE {m} END AS {m}" for m in (k.replace("_score", "_method") for k in D.OBJECTIVE_WEIGHTS))


@query("d11_winners_with_support", f"""SELECT category, support_count, scored_frame_count, {WIN_OUT}, CASE WHEN category = 'no_face' OR scored_frame_count >= 900 THEN 'high' ELSE 'low_support' END AS policy_confidence,
  CASE WHEN category = 'no_face' THEN 'skip_face_anonymisation' ELSE balanced_method END AS final_decision,
  CASE WHEN category = 'no_face' THEN 'no_face_skip' WHEN scored_frame_count < 900 THEN 'low_support_fallback' ELSE 'highest_balanced_score' END AS reason
FROM (SELECT * REPLACE (CASE WHEN scored_frame_count < 900 THEN 'layered_blur_downscale_noise' ELSE balanced_method END AS balanced_method) FROM (
  SELECT category, max(support_count) AS support_count, max(scored_frame_count) AS scored_frame_count, {WIN} FROM cats GROUP BY category))""", ctes=CATS)
def _(v):
    return D.winners_with_support(cats(v), 900)


METHOD_TABLE = """mt AS MATERIALIZED (SELECT method, count(*) AS n, 1 - avg(success) AS failure_rate, CASE WHEN method IN ('nullface', 'diffusion_low_step') THEN 'RESEARCH_ONLY' ELSE 'ELIGIBLE' END AS visual_eligibility,
  avg(greatest(coalesce(reid_a, 0), coalesce(reid_b, 0))) AS mean_max_reid, avg(privacy_score) AS privacy_score, avg(utility_score) AS utility_score, avg(runtime_score) AS runtime_score, avg(success) AS success,
  0.55 * avg(privacy_score) + 0.35 * avg(utility_score) + 0.05 * avg(runtime_score) + 0.05 * avg(success) AS score FROM scored_metrics GROUP BY method),
gated AS MATERIALIZED (SELECT *, failure_rate > 0.05 AS gate_failure, visual_eligibility <> 'ELIGIBLE' AS gate_visual, mean_max_reid > 0.40 AS gate_privacy_balanced, mean_max_reid > 0.10 AS gate_privacy_strict FROM mt)"""


def method_table(v):
    eligibility = F.when(C("method").isin("nullface", "diffusion_low_step"), "RESEARCH_ONLY").otherwise("ELIGIBLE")
    out = v.scored_metrics.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), (1 - F.avg("success")).alias("failure_rate"),
        F.avg(F.greatest(F.coalesce("reid_a", F.lit(0.0)), F.coalesce("reid_b", F.lit(0.0)))).alias("mean_max_reid"),
        *[F.avg(c).alias(c) for c in D.SCORE_PARTS])
    return out.withColumns({"visual_eligibility": eligibility, "score": D.weighted_score({"privacy_score": 0.55, "utility_score": 0.35, "runtime_score": 0.05, "success": 0.05})})


MT_COLS = "failure_rate mean_max_reid privacy_score utility_score runtime_score success score"


@query("d12_safety_gates", """SELECT *, NOT gate_failure AND NOT gate_visual AS deployable, NOT gate_failure AND NOT gate_visual AND NOT gate_privacy_balanced AS eligible_balanced,
  NOT gate_failure AND NOT gate_visual AND NOT gate_privacy_strict AS eligible_privacy_first FROM gated""", ctes=METHOD_TABLE, dbl=MT_COLS)
def _(v):
    return D.safety_gates(method_table(v))


@query("d12_recall_gate", "SELECT source, subgroup, recall, recall >= 0.45 AS promotable FROM sub_scores", ctes=SUBGROUP, dbl="recall")
def _(v):
    return D.recall_gate(subgroup_scores(v), 0.45).select("source", "subgroup", "recall", "promotable")


@query("d13_eligible_ranking", """SELECT method, score, ranking, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, method) AS place FROM (
  SELECT *, CASE WHEN NOT gate_failure AND NOT gate_visual AND NOT gate_privacy_balanced THEN 'eligible' ELSE 'research' END AS ranking FROM gated)""", ctes=METHOD_TABLE, dbl="score")
def _(v):
    return D.eligible_ranking(D.safety_gates(method_table(v)), "score").select("method", "score", "ranking", "place")


@query("d14_pareto_methods", """SELECT g.subgroup, g.method, NOT EXISTS (SELECT 1 FROM pm o WHERE o.subgroup = g.subgroup AND o.p >= g.p AND o.u >= g.u AND o.r >= g.r AND (o.p > g.p OR o.u > g.u OR o.r > g.r)) AS pareto FROM pm g""",
       ctes="pm AS MATERIALIZED (SELECT subgroup, method, avg(privacy_score) AS p, avg(utility_score) AS u, avg(runtime_score) AS r FROM membership JOIN scored_metrics USING (image_id) GROUP BY ALL)")
def _(v):
    means = v.membership.join(v.scored_metrics, "image_id").groupBy("subgroup", "method").agg(
        F.avg("privacy_score").alias("p"), F.avg("utility_score").alias("u"), F.avg("runtime_score").alias("r"))
    # computed once: means summed in another order would miss their own front
    means = cut(means)
    return D.pareto(means, ["p", "u", "r"], ["subgroup"]).select("subgroup", "method", "pareto")


@query("d14_pareto_frames", """SELECT m.image_id, m.method FROM method_metrics m JOIN (
  SELECT g.* FROM (SELECT DISTINCT method, ssim, reid_a, runtime_seconds FROM method_metrics WHERE ssim IS NOT NULL AND reid_a IS NOT NULL AND runtime_seconds IS NOT NULL) g WHERE NOT EXISTS (
    SELECT 1 FROM method_metrics o WHERE o.method = g.method AND o.ssim >= g.ssim AND o.reid_a >= g.reid_a AND o.runtime_seconds >= g.runtime_seconds AND (o.ssim > g.ssim OR o.reid_a > g.reid_a OR o.runtime_seconds > g.runtime_seconds))) f
  ON m.method = f.method AND m.ssim = f.ssim AND m.reid_a = f.reid_a AND m.runtime_seconds = f.runtime_seconds""")
def _(v):
    rows = v.method_metrics.select("image_id", "method", "ssim", "reid_a", "runtime_seconds").dropna()
    return D.pareto(rows, ["ssim", "reid_a", "runtime_seconds"], ["method"]).filter("pareto").select("image_id", "method")


WEIGHTS = [(0.4, 0.5), (0.5, 0.4), (0.55, 0.35), (0.65, 0.25), (0.75, 0.15)]
WEIGHT_SQL = ", ".join(f"({a}, {b})" for a, b in WEIGHTS)


@query("d15_weight_sensitivity", f"""SELECT privacy_weight, utility_weight, method, s AS score FROM (SELECT w.privacy_weight, w.utility_weight, method, w.privacy_weight * privacy_score + w.utility_weight * utility_score + 0.05 * runtime_score + 0.05 * success AS s,
  row_number() OVER (PARTITION BY w.privacy_weight, w.utility_weight ORDER BY w.privacy_weight * privacy_score + w.utility_weight * utility_score + 0.05 * runtime_score + 0.05 * success DESC, method) AS rk
  FROM mt CROSS JOIN (SELECT CAST(a AS DOUBLE) AS privacy_weight, CAST(b AS DOUBLE) AS utility_weight FROM (VALUES {WEIGHT_SQL}) AS t(a, b)) w) WHERE rk = 1""", ctes=METHOD_TABLE, dbl="privacy_weight utility_weight score")
def _(v):
    return D.weight_sensitivity(method_table(v), WEIGHTS, {"runtime_score": 0.05, "success": 0.05})


@query("d16_objective_modes", " UNION ALL ".join(f"SELECT method, '{n}' AS mode, {w[0]} * privacy_score + {w[1]} * utility_score + {w[2]} * runtime_score + {w[3]} * success AS score FROM mt" for n, w in D.OBJECTIVE_MODES.items()), ctes=METHOD_TABLE, dbl="score")
def _(v):
    return D.objective_modes(method_table(v))


SURE = "sure AS MATERIALIZED (SELECT image_id FROM pred_conditions WHERE no_face = 1 AND box_count = 0)"
COPIED = "SELECT DISTINCT image_id, 'no_action_copy' AS selected_method, 1.0 AS score, 1.0 AS privacy, 1.0 AS utility, 'verified_no_face' AS selection_reason{} FROM enh WHERE image_id IN (SELECT image_id FROM sure)"


def confident_no_face(v):
    return v.pred_conditions.filter((C("no_face") == 1) & (C("box_count") == 0)).select("image_id")


@query("d17_constrained_best", """SELECT image_id, method AS selected_method, enhanced_score AS score, privacy3 AS privacy, utility3 AS utility, 'maximum_utility_after_privacy_quality_gates' AS selection_reason, tier FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tier, utility3 DESC, runtime_high_compute DESC, method) AS rk FROM (
  SELECT *, CASE WHEN success = 1 AND privacy3 >= 0.8 AND utility3 >= 0.55 THEN 0 WHEN success = 1 AND privacy3 >= 0.8 THEN 1 WHEN method = 'solid_mask_black' THEN 2 END AS tier FROM enh) WHERE tier IS NOT NULL) WHERE rk = 1 AND image_id NOT IN (SELECT image_id FROM sure)
UNION ALL """ + COPIED.format(", -1"), ctes=ENH + "," + SURE, dbl="score privacy utility", big="tier")
def _(v):
    return D.constrained_best(enhanced(v), 0.8, 0.55, confident_no_face(v))


ORDER = ["pixelate", "blur", "layered_blur_downscale_noise", "diffusion_low_step", "nullface"]
CASCADE = SURE + """, casc AS MATERIALIZED (SELECT image_id, method AS selected_method, enhanced_score AS score, privacy3 AS privacy, utility3 AS utility, CASE WHEN place = 5 THEN 'terminal_solid_mask_fallback' ELSE 'first_candidate_passing_privacy_and_quality' END AS selection_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY place) AS rk FROM (SELECT *, CASE WHEN success = 1 AND privacy3 >= 0.6 AND utility3 >= 0.55 AND method <> 'solid_mask_black' THEN list_position(['pixelate', 'blur', 'layered_blur_downscale_noise', 'diffusion_low_step', 'nullface'], method) - 1
    WHEN method = 'solid_mask_black' THEN 5 END AS place FROM enh) WHERE place IS NOT NULL) WHERE rk = 1 AND image_id NOT IN (SELECT image_id FROM sure)
  UNION ALL """ + COPIED.format("") + ")"


def cascaded(v):
    return D.cascade(enhanced(v), ORDER, 0.6, 0.55, confident_no_face(v))


@query("d18_cascade", "SELECT * FROM casc", ctes=ENH + "," + CASCADE, dbl="score privacy utility")
def _(v):
    return cascaded(v)


def routes(v):
    sure = (C("no_face") == 1) & (C("box_count") == 0)
    return v.pred_conditions.select("image_id", "participant_id", L.first_true_category("", sure).alias("policy_category"), sure.alias("confident_no_face"))


ROUTED = ENH + f""",
routes AS MATERIALIZED (SELECT image_id, participant_id, no_face = 1 AND box_count = 0 AS confident_no_face, CASE WHEN no_face = 1 AND box_count = 0 THEN 'no_face' ELSE {CATEGORY_SQL} END AS policy_category FROM pred_conditions),""" + FOLDS.format(src="routes") + """,
routed AS MATERIALIZED (SELECT r.*, f.fold FROM routes r JOIN folds f USING (participant_id)),
own AS MATERIALIZED (SELECT r.fold, r.policy_category, e.method, sum(e.enhanced_score) AS s, sum(e.privacy3) AS p, sum(e.success) AS u, count(*) AS n FROM enh e JOIN routed r USING (image_id) {where} GROUP BY ALL),
cm AS MATERIALIZED (SELECT g.fold, t.policy_category, t.method, (t.s - coalesce(o.s, 0)) / nullif(t.n - coalesce(o.n, 0), 0) AS s, (t.p - coalesce(o.p, 0)) / nullif(t.n - coalesce(o.n, 0), 0) AS p, (t.u - coalesce(o.u, 0)) / nullif(t.n - coalesce(o.n, 0), 0) AS u
  FROM (SELECT DISTINCT fold FROM routed) g CROSS JOIN (SELECT policy_category, method, sum(s) AS s, sum(p) AS p, sum(u) AS u, sum(n) AS n FROM own GROUP BY ALL) t LEFT JOIN own o ON o.fold = g.fold AND o.policy_category = t.policy_category AND o.method = t.method),
gm AS MATERIALIZED (SELECT g.fold, t.method, (t.s - o.s) / (t.n - o.n) AS s, (t.p - o.p) / (t.n - o.n) AS p, (t.u - o.u) / (t.n - o.n) AS u FROM (SELECT DISTINCT fold FROM routed) g CROSS JOIN (SELECT method, sum(s) AS s, sum(p) AS p, sum(u) AS u, sum(n) AS n FROM own GROUP BY ALL) t
  JOIN (SELECT fold, method, sum(s) AS s, sum(p) AS p, sum(u) AS u, sum(n) AS n FROM own GROUP BY ALL) o ON o.fold = g.fold AND o.method = t.method),
bc AS MATERIALIZED (SELECT fold, policy_category, arg_min(method, {{'s': -round(s, 9), 'm': method}}) AS category_method FROM cm WHERE s IS NOT NULL {gate} GROUP BY ALL),
bg AS MATERIALIZED (SELECT fold, arg_min(method, {{'s': -round(s, 9), 'm': method}}) AS global_method FROM gm WHERE s IS NOT NULL {gate} GROUP BY ALL)"""
STANDARD = ", ".join(f"'{m}'" for m in D.STANDARD_METHODS)


def routed_sql(where: str, gate: str) -> str:
    return ROUTED.replace("{where}", where).replace("{gate}", gate).replace("{{", "{").replace("}}", "}")


HELD = routed_sql(f"WHERE e.method IN ({STANDARD})", "") + """,
held AS MATERIALIZED (SELECT d.fold, d.image_id, d.policy_category, d.selected_method, d.selection_source, CASE WHEN idle THEN 1.0 ELSE coalesce(e.enhanced_score, 0) END AS score, CASE WHEN idle THEN 1.0 ELSE coalesce(e.privacy3, 0) END AS privacy, CASE WHEN idle THEN 1.0 ELSE coalesce(e.utility3, 0) END AS utility FROM (
  SELECT r.*, r.policy_category = 'no_face' AND r.confident_no_face AS idle, CASE WHEN r.policy_category = 'no_face' AND r.confident_no_face THEN 'no_action_copy' ELSE coalesce(category_method, global_method) END AS selected_method,
    CASE WHEN r.policy_category = 'no_face' AND r.confident_no_face THEN 'verified_no_face' WHEN category_method IS NOT NULL THEN 'train_fold_category' ELSE 'train_fold_global_fallback' END AS selection_source
  FROM routed r LEFT JOIN bc USING (fold, policy_category) LEFT JOIN bg USING (fold)) d LEFT JOIN enh e ON e.image_id = d.image_id AND e.method = d.selected_method)"""


def heldout(v):
    return D.heldout_policy(enhanced(v), routes(v), D.STANDARD_METHODS)


@query("d19_heldout_policy", "SELECT * FROM held", ctes=HELD, dbl="score privacy utility")
def _(v):
    return heldout(v)


GATED = routed_sql("", "AND p >= 0.6 AND u >= 0.97") + """,
first_pick AS MATERIALIZED (SELECT r.fold, r.image_id, confident_no_face AS idle, CASE WHEN confident_no_face THEN 'no_face' ELSE r.policy_category END AS policy_category, CASE WHEN confident_no_face THEN 'no_action_copy' ELSE coalesce(category_method, global_method, 'solid_mask_black') END AS first_method,
  CASE WHEN confident_no_face THEN 'verified_no_face' WHEN category_method IS NOT NULL THEN 'train_fold_category' WHEN global_method IS NOT NULL THEN 'train_fold_global_fallback' ELSE 'terminal_privacy_fallback' END AS src
  FROM routed r LEFT JOIN bc USING (fold, policy_category) LEFT JOIN bg USING (fold)),
rescue AS (SELECT image_id, arg_min(method, {'u': (NOT (success = 1 AND privacy3 >= 0.6))::INT, 's': -enhanced_score, 'm': method}) AS rescue_method FROM enh WHERE method IN ('layered_blur_downscale_noise', 'solid_mask_black') AND ((success = 1 AND privacy3 >= 0.6) OR method = 'solid_mask_black') GROUP BY image_id),
final_pick AS MATERIALIZED (SELECT p.fold, p.image_id, p.policy_category, p.idle, CASE WHEN NOT idle AND coalesce(e.success, 0) < 1 THEN coalesce(rescue_method, 'solid_mask_black') ELSE first_method END AS selected_method,
  CASE WHEN NOT idle AND coalesce(e.success, 0) < 1 THEN 'runtime_failure_fallback' ELSE src END AS selection_source FROM first_pick p LEFT JOIN enh e ON e.image_id = p.image_id AND e.method = p.first_method LEFT JOIN rescue r ON r.image_id = p.image_id)"""


@query("d20_heldout_policy_gated", """SELECT d.fold, d.image_id, d.policy_category, d.selected_method, d.selection_source, CASE WHEN idle THEN 1.0 ELSE coalesce(e.enhanced_score, 0) END AS score, CASE WHEN idle THEN 1.0 ELSE coalesce(e.privacy3, 0) END AS privacy, CASE WHEN idle THEN 1.0 ELSE coalesce(e.utility3, 0) END AS utility
FROM final_pick d LEFT JOIN enh e ON e.image_id = d.image_id AND e.method = d.selected_method""", ctes=GATED, dbl="score privacy utility")
def _(v):
    return D.heldout_policy_gated(enhanced(v), routes(v), privacy_floor=0.6, success_floor=0.97)


def mode_sql(mode: str, column: str, allowed) -> str:
    inside = ", ".join(f"'{m}'" for m in allowed)
    return f"""SELECT '{mode}' AS objective_mode, category, CASE WHEN max(scored_frame_count) >= 20 THEN arg_min(method, {{'s': -{column}, 'm': method}}) ELSE 'layered_blur_downscale_noise' END AS selected_method,
  CASE WHEN max(scored_frame_count) >= 20 THEN 'highest_{column}_for_' || category ELSE 'low_support_or_missing_category_fallback' END AS selection_reason FROM cats WHERE method IN ({inside}) GROUP BY category"""


CHOICES = CATS + ", choices AS MATERIALIZED (" + " UNION ALL ".join(mode_sql(m, c, a) for m, (c, a) in D.POLICY_MODES.items()) + f"""),
log_frames AS (SELECT image_id, CASE WHEN no_face = 1 AND box_count = 0 THEN 'no_face' ELSE {CATEGORY_SQL} END AS category FROM pred_conditions),
plog AS MATERIALIZED (SELECT f.image_id, m.objective_mode, f.category, CASE WHEN f.category = 'no_face' THEN 'no_action_copy' ELSE coalesce(c.selected_method, 'layered_blur_downscale_noise') END AS selected_method,
  CASE WHEN f.category = 'no_face' THEN 'verified_no_face' ELSE coalesce(c.selection_reason, 'low_support_or_missing_category_fallback') END AS selection_reason
  FROM log_frames f CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in D.POLICY_MODES)}]) AS objective_mode) m LEFT JOIN choices c ON c.objective_mode = m.objective_mode AND c.category = f.category)"""


def policy_log(v):
    sure = (C("no_face") == 1) & (C("box_count") == 0)
    frames = v.pred_conditions.select("image_id", L.first_true_category("", sure).alias("category"))
    return D.full_policy_log(frames, cats(v), v.scored_metrics)


REJECTED = "CASE WHEN l.category = 'no_face' THEN 0 ELSE 9 - (l.selected_method IN ('blur', 'pixelate', 'solid_mask_black', 'layered_blur_downscale_noise', 'nullface', 'diffusion_low_step', 'reverse_personalization'))::INT END"


@query("d21_full_policy_log", f"""SELECT l.image_id, l.objective_mode, l.category, l.selected_method, l.selection_reason, {REJECTED} AS n_rejected,
  CASE WHEN l.category = 'no_face' THEN 1.0 ELSE privacy_score END AS actual_privacy_score, CASE WHEN l.category = 'no_face' THEN 1.0 ELSE utility_score END AS actual_utility_score,
  CASE WHEN l.category = 'no_face' THEN 'ok' WHEN s.status IS NULL THEN 'missing_metric_row' WHEN s.status = 'failed' THEN 'failed' ELSE 'ok' END AS status
FROM plog l LEFT JOIN scored_metrics s ON s.image_id = l.image_id AND s.method = l.selected_method""", ctes=CHOICES, dbl="actual_privacy_score actual_utility_score", big="n_rejected")
def _(v):
    return policy_log(v).select("image_id", "objective_mode", "category", "selected_method", "selection_reason", F.size("rejected_methods").alias("n_rejected"),
                                "actual_privacy_score", "actual_utility_score", "status")


@query("d22_rule_router", """SELECT image_id, CASE WHEN largest_face_size_px <= 120 THEN 'small_or_medium_face' WHEN blur_score >= 350 THEN 'high_blur' ELSE 'sharper_large_face' END AS route_reason,
  CASE WHEN largest_face_size_px <= 120 OR blur_score >= 350 THEN 'blur' ELSE 'pixelate' END AS method FROM quality_frame""")
def _(v):
    rows = v.quality_frame.select("image_id", C("largest_face_size_px").alias("face_size_px"), "blur_score")
    return D.rule_router(rows, 120, 350).select("image_id", "route_reason", "method")


OBJECTIVES = ("privacy_first", "utility_priority", "utility_under_privacy_floor", "runtime_aware", "compute_profile_adaptive", "failure_avoidance", "multimodal_risk")
PROFILE_NAMES = ("cpu_or_very_low_resource", "unknown_or_unstable_profile", "low_vram_local_gpu", "stronger_accelerator_constrained_compute")


def router_rows(v):
    i = C("image_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (i % k + 1).cast("int"))
    rows = v.quality_frame.select(
        "image_id", C("face_count"), C("largest_face_size_px").alias("dominant_height"), F.when(C("face_count") == 0, "none").when(i % 5 == 0, "high").otherwise("possible").alias("face_risk"),
        F.when(C("text_score") >= 42, "high").when(C("text_score") >= 36, "possible").otherwise("none").alias("text_risk"), F.when(C("screen_score") >= 0.35, "high").otherwise("low").alias("screen_risk"),
        F.when(i % 4 == 0, "high_method_failure_risk").when(i % 4 == 1, "medium_method_failure_risk").otherwise("low_method_failure_risk").alias("artifact_risk"),
        F.when(C("motion_blur_flag"), "high_source_blur").otherwise("clean").alias("quality_condition"), F.when(C("small_face_flag"), "small_face").otherwise("unknown").alias("pose_condition"),
        pick(PROFILE_NAMES, 4).alias("compute_profile"))
    return rows.withColumn("objective", F.explode(F.array(*[F.lit(o) for o in OBJECTIVES])))


ROUTER = f"""rt AS MATERIALIZED (SELECT image_id, face_count, largest_face_size_px AS dominant_height, CASE WHEN face_count = 0 THEN 'none' WHEN image_id % 5 = 0 THEN 'high' ELSE 'possible' END AS face_risk, text_score >= 36 AS text, screen_score >= 0.35 AS screen,
  CASE image_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS art, motion_blur_flag AS blurred, small_face_flag AS small, [{', '.join(f"'{p}'" for p in PROFILE_NAMES)}][image_id % 4 + 1] AS profile, o.objective
  FROM quality_frame CROSS JOIN (SELECT unnest([{', '.join(f"'{o}'" for o in OBJECTIVES)}]) AS objective) o),
rt_m AS (SELECT *, CASE WHEN face_count = 0 AND face_risk = 'none' AND NOT text AND NOT screen THEN 'copy'
  WHEN objective = 'privacy_first' THEN CASE WHEN text OR screen OR face_count >= 1 THEN 'solid_mask' ELSE 'blur' END
  WHEN objective IN ('utility_priority', 'utility_under_privacy_floor') THEN CASE WHEN text OR screen THEN 'solid_mask' WHEN art = 'low' AND face_risk <> 'high' THEN 'pixelate' ELSE 'blur' END
  WHEN objective = 'runtime_aware' THEN CASE WHEN art = 'high' OR face_count <= 1 THEN 'blur' ELSE 'layered' END
  WHEN objective = 'compute_profile_adaptive' THEN CASE WHEN profile IN ('cpu_or_very_low_resource', 'unknown_or_unstable_profile') THEN 'blur' WHEN text OR screen THEN 'solid_mask' WHEN face_count >= 2 AND face_risk = 'high' THEN 'layered' ELSE 'blur' END
  WHEN objective = 'failure_avoidance' THEN CASE WHEN art IN ('high', 'medium') OR small THEN 'blur' ELSE 'layered' END
  WHEN objective = 'multimodal_risk' THEN CASE WHEN text OR screen THEN 'solid_mask' WHEN face_count = 0 THEN 'copy' ELSE 'blur' END ELSE 'blur' END AS selected_method FROM rt)"""


@query("d23_objective_router", """SELECT image_id, objective, selected_method,
  CASE WHEN selected_method = 'copy' AND (objective <> 'multimodal_risk' OR face_risk = 'none') THEN 'copy_without_privacy_action' WHEN selected_method = 'copy' THEN 'copy_without_face_action'
    WHEN selected_method = 'solid_mask' THEN CASE WHEN text OR screen THEN 'face_anonymisation_plus_multimodal_demo_redaction' ELSE 'face_anonymisation_solid_mask' END
    WHEN selected_method = 'layered' AND objective <> 'compute_profile_adaptive' THEN 'face_anonymisation_layered' ELSE 'face_anonymisation_blur' END AS selected_action,
  CASE WHEN quiet THEN 'not_applicable_no_detected_or_reviewed_risk' WHEN selected_method = 'pixelate' THEN 'bounded_low_privacy_utility_mode' ELSE 'passed_by_confirmatory_or_privacy_first_method' END AS privacy_floor_status,
  CASE WHEN quiet THEN 'preserved' WHEN objective IN ('utility_priority', 'utility_under_privacy_floor') THEN CASE selected_method WHEN 'solid_mask' THEN 'utility_deprioritized_due_to_non_face_privacy_risk' WHEN 'pixelate' THEN 'high_utility_low_privacy' ELSE 'privacy_floor_prevents_pixelate' END ELSE 'not_optimized' END AS utility_status,
  CASE WHEN objective = 'runtime_aware' AND NOT quiet THEN 'fast_deterministic_method_selected' ELSE 'within_local_deterministic_budget' END AS runtime_status,
  CASE WHEN quiet THEN 'not_applicable' ELSE 'passed_for_deterministic_method' END AS quality_gate_status,
  CASE WHEN quiet THEN 'demo' WHEN selected_method = 'pixelate' THEN 'bounded' ELSE 'confirmatory' END AS evidence_level,
  CASE WHEN objective = 'privacy_first' AND selected_method = 'solid_mask' THEN 'high_cost' WHEN selected_method = 'pixelate' THEN 'low_cost' ELSE 'medium' END AS expected_utility_cost,
  selected_method NOT IN ('copy', 'pixelate') AND face_count = 0 AND face_risk <> 'none' AS unseen_risk,
  3 + (objective IN ('utility_priority', 'utility_under_privacy_floor'))::INT + (profile = 'stronger_accelerator_constrained_compute' AND face_count >= 1 AND dominant_height >= 150)::INT AS n_eligible,
  CASE WHEN profile IN ('low_vram_local_gpu', 'stronger_accelerator_constrained_compute') AND face_count = 1 AND dominant_height >= 180 THEN 'requires_apparent_demographic_and_quality_gate_before_promotion' WHEN blurred THEN 'rejected_by_source_quality_gate'
    WHEN profile IN ('cpu_or_very_low_resource', 'unknown_or_unstable_profile') THEN 'not_eligible_for_current_compute_profile' ELSE 'full_metric_but_quality_and_runtime_limited_non_default' END AS nullface_reason,
  8 + (selected_method IN ('pixelate', 'solid_mask', 'layered'))::INT AS n_rejected, concat_ws('|', CASE WHEN text THEN 'text_redaction_demo_region' END, CASE WHEN screen THEN 'screen_redaction_demo_region' END) AS actions
  FROM (SELECT *, face_count = 0 AND face_risk = 'none' AND NOT text AND NOT screen AS quiet FROM rt_m)""",
       ctes=ROUTER, big="n_eligible n_rejected")
def _(v):
    out = D.objective_router(router_rows(v))
    return out.select("image_id", "objective", "selected_method", "selected_action", "privacy_floor_status", "utility_status", "runtime_status", "quality_gate_status", "evidence_level", "expected_utility_cost",
                      (C("residual_risk") == D.RISK_WITHOUT_BOXES).alias("unseen_risk"), F.size("eligible_methods").alias("n_eligible"), C("rejected_methods")["NullFace"].alias("nullface_reason"),
                      F.size("rejected_methods").alias("n_rejected"), F.array_join("multimodal_actions", "|").alias("actions"))


PREDICTABLE = ["large_face", "low_light_or_dim", "multi_face", "high_clutter"]
BEST1 = """best1 AS MATERIALIZED (SELECT subgroup, arg_max(source, {'c': composite, 'r': recall, 's': source}) AS model, max(composite) AS score, arg_max(recall, {'c': composite, 'r': recall, 's': source}) AS recall FROM sub_scores GROUP BY subgroup)"""


def best_models(s):
    order = F.struct("composite", "recall", "source")
    return s.groupBy("subgroup").agg(F.max_by("source", order).alias("model"), F.max("composite").alias("score"), F.max_by("recall", order).alias("recall"))


@query("d24_detector_decision", """SELECT b.subgroup, b.model AS best_model, round(b.score - d.composite, 6) AS margin, CASE WHEN b.subgroup = 'overall' THEN 'global_default' WHEN b.subgroup NOT IN ('large_face', 'low_light_or_dim', 'multi_face', 'high_clutter') THEN 'fallback_unpredictable'
  WHEN b.model = 'yolo' THEN 'route_to_default' WHEN round(b.score - d.composite, 6) >= 0.01 THEN 'route_to_category_winner' ELSE 'fallback_small_margin' END AS decision
FROM best1 b JOIN sub_scores d ON d.subgroup = b.subgroup AND d.source = 'yolo'""", ctes=SUBGROUP + "," + BEST1, dbl="margin")
def _(v):
    scores = subgroup_scores(v)
    best = best_models(scores).select("subgroup", C("model").alias("best_model"), C("score").alias("best_score"))
    default = scores.filter(C("source") == "yolo").select("subgroup", C("composite").alias("score"))
    return D.detector_decision(best, default, PREDICTABLE, "yolo").select("subgroup", "best_model", "margin", "decision")


ABSTAIN = SUBGROUP + "," + BEST1 + """,
fb AS (SELECT model, score, recall FROM best1 WHERE subgroup = 'overall'),
opt AS (SELECT g.image_id, max({'s': b.score, 'g': g.subgroup, 'm': b.model, 'r': b.recall}) AS b FROM membership g JOIN best1 b USING (subgroup) WHERE g.subgroup IN ('large_face', 'low_light_or_dim', 'multi_face', 'high_clutter') GROUP BY g.image_id),
abst AS MATERIALIZED (SELECT c.image_id, coalesce(o.b.s > fb.score, FALSE) AS routed, o.b AS b, fb.model AS fm, fb.score AS fs, fb.recall AS fr FROM conditions c CROSS JOIN fb LEFT JOIN opt o ON o.image_id = c.image_id)"""


def abstain(v, scores):
    best = best_models(scores)
    labels = v.membership.filter(C("subgroup").isin("overall", *PREDICTABLE))
    return D.abstaining_router(labels, best, best.filter(C("subgroup") == "overall"))


@query("d25_abstaining_router", """SELECT image_id, CASE WHEN routed THEN b.g ELSE 'overall' END AS selected_subgroup, CASE WHEN routed THEN b.m ELSE fm END AS selected_model, CASE WHEN routed THEN b.s ELSE fs END AS expected_score,
  CASE WHEN routed THEN b.r ELSE fr END AS expected_recall, NOT routed AS abstained FROM abst""", ctes=ABSTAIN, dbl="expected_score expected_recall")
def _(v):
    return abstain(v, subgroup_scores(v))


@query("d25_router_summary", """SELECT m.routing_mode, m.image_rows, m.routed_rows, m.abstained_rows, m.mean_score, m.mean_recall, f.routing_mode AS best_fixed, m.mean_score - f.mean_score AS delta_score, m.mean_recall - f.mean_recall AS delta_recall
FROM rs m CROSS JOIN (SELECT * FROM rs WHERE starts_with(routing_mode, 'fixed_') ORDER BY mean_score DESC, routing_mode DESC LIMIT 1) f""", ctes=ABSTAIN + """,
rs AS MATERIALIZED (SELECT 'oracle_selective_router' AS routing_mode, count(*) AS image_rows, count(*) FILTER (routed) AS routed_rows, count(*) FILTER (NOT routed) AS abstained_rows, avg(CASE WHEN routed THEN b.s ELSE fs END) AS mean_score, avg(CASE WHEN routed THEN b.r ELSE fr END) AS mean_recall FROM abst
  UNION ALL SELECT 'fixed_' || s.source, count(*), count(*), 0, avg(s.composite), avg(s.recall) FROM conditions CROSS JOIN sub_scores s WHERE s.subgroup = 'overall' GROUP BY s.source)""", dbl="mean_score mean_recall delta_score delta_recall")
def _(v):
    scores = subgroup_scores(v)
    overall = F.broadcast(scores.filter(C("subgroup") == "overall").select("source", C("composite").alias("expected_score"), C("recall").alias("expected_recall"), F.lit(False).alias("abstained")))
    fixed = v.conditions.select("image_id").crossJoin(overall)
    modes = {"oracle_selective_router": abstain(v, scores), **{f"fixed_{s}": fixed.filter(C("source") == s) for s in ("rfdetr", "scrfd", "yolo")}}
    return D.router_summary(modes)


ATTEMPT = "CASE WHEN box_count = 0 THEN 'no_action_copy' WHEN image_id % 2 = 0 THEN 'nullface' ELSE 'blur' END"


@query("d26_materialise_routes", f"""SELECT r.image_id, attempted_method, CASE WHEN attempted_method <> 'nullface' THEN 'not_required' WHEN hit THEN 'replaced' ELSE 'accepted' END AS gate_action, final_method,
  CASE WHEN final_method = 'no_action_copy' THEN 0.0 ELSE coalesce(e.runtime_for_score, 0) + CASE WHEN hit THEN a.runtime_for_score ELSE 0 END + CASE WHEN attempted_method = 'nullface' THEN 0.05 ELSE 0 END END AS component_runtime_seconds,
  CASE WHEN final_method = 'no_action_copy' THEN 1.0 ELSE e.enhanced_score END AS balanced_score
FROM (SELECT *, attempted_method = 'nullface' AND image_id % 3 = 0 AS hit, CASE WHEN attempted_method = 'nullface' AND image_id % 3 = 0 THEN 'layered_blur_downscale_noise' ELSE attempted_method END AS final_method FROM (SELECT image_id, {ATTEMPT} AS attempted_method FROM conditions)) r
LEFT JOIN enh e ON e.image_id = r.image_id AND e.method = r.final_method LEFT JOIN enh a ON a.image_id = r.image_id AND a.method = 'nullface'""", ctes=ENH, dbl="component_runtime_seconds balanced_score")
def _(v):
    attempt = v.conditions.select("image_id", F.when(C("box_count") == 0, "no_action_copy").when(C("image_id") % 2 == 0, "nullface").otherwise("blur").alias("attempted_method"))
    gate = v.conditions.select("image_id", F.when(C("image_id") % 3 == 0, 1).otherwise(0).alias("predicted_artifact"))
    return D.materialise_routes(attempt, gate, enhanced(v), "nullface").drop("privacy_score", "utility_score")


@query("d27_resolve_retries", """SELECT image_id, method, CASE WHEN there THEN CASE WHEN again AND status IN ('ok', 'existing') THEN 'ok' ELSE status END WHEN again THEN 'recovered_after_retry' ELSE 'failed_after_retry' END AS status,
  CASE WHEN there THEN 'original_comparable_run' WHEN again THEN 'retry_b' ELSE 'persistent_failure' END AS source FROM (SELECT image_id, method, status, status <> 'failed' AS there, image_id % 3 <> 1 AS again FROM method_metrics)""")
def _(v):
    keys = ["image_id", "method"]
    original = v.method_metrics.select(*keys, "status", (C("status") != "failed").alias("output_exists"))
    retries = v.method_metrics.select(*keys, F.when(C("image_id") % 3 == 0, "RECOVERED").when(C("image_id") % 3 == 2, "RECOVERED_EXISTING_OUTPUT").otherwise("FAILED").alias("retry_status"), F.lit("retry_b").alias("retry_variant"))
    return D.resolve_retries(v.method_metrics.select(*keys), original, retries, keys)


RISK = """rv AS MATERIALIZED (SELECT CASE WHEN q.visible_text_flag AND q.visible_screen_flag THEN 'text_and_screen_present' WHEN q.visible_text_flag THEN 'text_present' WHEN q.visible_screen_flag THEN 'screen_present' ELSE 'no_text_screen_risk' END AS risk_state, s.method AS variant,
  0.5 * avg(s.privacy_score) + 0.3 * avg(s.utility_score) + 0.1 * avg(s.runtime_score) + 0.1 * avg(s.success) AS score, avg(s.privacy_score) AS privacy, avg(s.utility_score) AS utility FROM quality_frame q JOIN scored_metrics s USING (image_id) GROUP BY ALL)"""


def risk_variants(v):
    text, screen = C("visible_text_flag"), C("visible_screen_flag")
    state = F.when(text & screen, "text_and_screen_present").when(text, "text_present").when(screen, "screen_present").otherwise("no_text_screen_risk")
    rows = v.quality_frame.select("image_id", state.alias("risk_state")).join(v.scored_metrics, "image_id")
    means = rows.groupBy("risk_state", C("method").alias("variant")).agg(*[F.avg(c).alias(c) for c in D.SCORE_PARTS])
    score = D.weighted_score({"privacy_score": 0.5, "utility_score": 0.3, "runtime_score": 0.1, "success": 0.1})
    return means.select("risk_state", "variant", score.alias("score"), C("privacy_score").alias("privacy"), C("utility_score").alias("utility"))


@query("d28_risk_state_policy", """SELECT risk_state, CASE WHEN idle THEN 'no_action_copy' ELSE variant END AS selected_variant, CASE WHEN NOT idle THEN score END AS score, CASE WHEN NOT idle THEN privacy END AS privacy, CASE WHEN NOT idle THEN utility END AS utility FROM (
  SELECT *, risk_state = 'no_text_screen_risk' AS idle, row_number() OVER (PARTITION BY risk_state ORDER BY score DESC, privacy DESC, variant) AS rk FROM rv) WHERE rk = 1""", ctes=RISK, dbl="score privacy utility")
def _(v):
    return R.risk_state_policy(risk_variants(v))


@query("d29_soft_floor_policy", """SELECT risk_state, variant, score, privacy, utility FROM (SELECT *, row_number() OVER (PARTITION BY risk_state ORDER BY utility DESC, score DESC, variant) AS rk FROM rv
  WHERE privacy >= 0.7 AND risk_state <> 'no_text_screen_risk') WHERE rk = 1""", ctes=RISK, dbl="score privacy utility")
def _(v):
    return R.soft_floor_policy(risk_variants(v), 0.7)


LEDGER = MODAL + """,
ledger AS MATERIALIZED (SELECT *, concat_ws('|', CASE WHEN gt_text > 0 AND pred_text = 0 THEN 'missed_text_presence' END, CASE WHEN gt_screen > 0 AND pred_screen = 0 THEN 'missed_screen_presence' END, CASE WHEN gt_text > 0 AND ocr_suppression < 0.5 THEN 'residual_text_readability' END) AS residual_classes FROM modal_p)"""


def ledger(v):
    c = C
    classes = [("missed_text_presence", (c("gt_text") > 0) & (c("pred_text") == 0)), ("missed_screen_presence", (c("gt_screen") > 0) & (c("pred_screen") == 0)),
               ("residual_text_readability", (c("gt_text") > 0) & (c("ocr_suppression") < 0.5))]
    return R.residual_ledger(D.modality_privacy(modal(v)), classes)


@query("d30_residual_ledger", """SELECT image_id, residual_classes, CASE WHEN residual_classes = '' THEN 'clear' WHEN contains(residual_classes, 'missed_') THEN 'detector_residual' ELSE 'localisation_or_ocr_residual' END AS disposition FROM ledger""", ctes=LEDGER)
def _(v):
    return ledger(v).select("image_id", "residual_classes", "disposition")


@query("a22_failure_rates", """SELECT failure_class, count(*) AS frame_count, (SELECT count(*) FROM ledger) AS total, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ledger) AS rate
FROM (SELECT unnest(string_split(CASE WHEN residual_classes = '' THEN 'NONE' ELSE residual_classes END, '|')) AS failure_class FROM ledger) GROUP BY failure_class""", ctes=LEDGER, dbl="rate")
def _(v):
    return R.failure_rates(ledger(v))


@query("a23_residual_summary", """SELECT view_type, method, count(*) AS n_images, avg(CASE WHEN text_missed THEN 1.0 ELSE 0.0 END) AS text_missed_rate, avg(CASE WHEN screen_missed THEN 1.0 ELSE 0.0 END) AS screen_missed_rate, avg(CASE WHEN text_missed OR screen_missed THEN 1.0 ELSE 0.0 END) AS any_flag_rate,
  avg(privacy_score) AS mean_privacy, avg(utility_score) AS mean_utility, avg(CASE WHEN privacy_score <= 0.01 THEN 1.0 ELSE 0.0 END) AS privacy_near_zero_rate FROM (
  SELECT f.view_type, s.method, m.gt_text > 0 AND m.pred_text = 0 AS text_missed, m.gt_screen > 0 AND m.pred_screen = 0 AS screen_missed, s.privacy_score, s.utility_score FROM modal m JOIN frames f USING (image_id) JOIN scored_metrics s ON s.image_id = m.image_id) GROUP BY view_type, method""",
       ctes=MODAL, dbl="text_missed_rate screen_missed_rate any_flag_rate mean_privacy mean_utility privacy_near_zero_rate")
def _(v):
    rows = modal(v).withColumns({"text_missed": (C("gt_text") > 0) & (C("pred_text") == 0), "screen_missed": (C("gt_screen") > 0) & (C("pred_screen") == 0)})
    scored = v.scored_metrics.select("image_id", "method", "privacy_score", "utility_score")
    rows = rows.join(v.frames.select("image_id", "view_type"), "image_id").join(scored, "image_id")
    return R.residual_summary(rows, ["text_missed", "screen_missed"], ["view_type", "method"])


@query("a24_review_field_counts", """SELECT field, value, count(*) AS count FROM (SELECT 'camera_stream_id' AS field, camera_stream_id AS value FROM frames UNION ALL SELECT 'view_type', view_type FROM frames UNION ALL SELECT 'integrity_status', integrity_status FROM frames) GROUP BY ALL""")
def _(v):
    return R.review_field_counts(v.frames, ["camera_stream_id", "view_type", "integrity_status"])


LEVELS = ["low", "medium", "high"]


@query("a25_adjudicate", """SELECT image_id, field, pass_1, pass_2, CASE WHEN field = 'risk' THEN CASE WHEN list_position(['low', 'medium', 'high'], pass_1) >= list_position(['low', 'medium', 'high'], pass_2) THEN pass_1 ELSE pass_2 END
  ELSE CASE WHEN list_position(['low', 'medium', 'high'], pass_1) <= list_position(['low', 'medium', 'high'], pass_2) THEN pass_1 ELSE pass_2 END END AS final FROM (
  SELECT image_id, 'risk' AS field, ['low', 'medium', 'high'][image_id % 3 + 1] AS pass_1, ['low', 'medium', 'high'][image_id % 7 % 3 + 1] AS pass_2 FROM frames
  UNION ALL SELECT image_id, 'clarity', ['low', 'medium', 'high'][image_id % 5 % 3 + 1], ['low', 'medium', 'high'][image_id % 3 + 1] FROM frames) WHERE pass_1 <> pass_2""")
def _(v):
    level = lambda e: F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (e % 3 + 1).cast("int"))
    i = C("image_id")
    first = v.frames.select("image_id", level(i).alias("risk"), level(i % 5).alias("clarity"))
    second = v.frames.select("image_id", level(i % 7).alias("risk"), level(i).alias("clarity"))
    return R.adjudicate(first, second, "image_id", {"risk": LEVELS}, {"clarity": LEVELS})


@query("d31_oracle_selector", """SELECT 'privacy_first' AS objective, arg_min(method, {'v': -privacy_score, 'm': method}) AS oracle_method FROM mt UNION ALL SELECT 'utility_first', arg_min(method, {'v': -utility_score, 'm': method}) FROM mt
UNION ALL SELECT 'lowest_failure', arg_min(method, {'v': failure_rate, 'm': method}) FROM mt""", ctes=METHOD_TABLE)
def _(v):
    return R.oracle_selector(method_table(v), {"privacy_first": ("privacy_score", "max"), "utility_first": ("utility_score", "max"), "lowest_failure": ("failure_rate", "min")})


ABLATE = {"A0_full": (), "A1_no_visual": ("gate_visual",), "A2_no_privacy": ("gate_privacy_balanced",), "A3_no_failure": ("gate_failure",)}


@query("d32_ablation_table", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS ablation, '{'|'.join(s) or 'none'}' AS removed, method, score, mean_max_reid, visual_eligibility = 'ELIGIBLE' AS visual_safe FROM gated WHERE {' AND '.join(f'NOT {g}' for g in ('gate_failure', 'gate_visual', 'gate_privacy_balanced') if g not in s)} ORDER BY score DESC, method LIMIT 1)"
    for n, s in ABLATE.items()), ctes=METHOD_TABLE, dbl="score mean_max_reid")
def _(v):
    return R.ablation_table(method_table(v), "score", ABLATE)


@query("d33_objective_profile_route", """SELECT image_id, objective, focus, CASE WHEN box_count = 0 THEN 'copy' WHEN focus = 'privacy' THEN 'solid_mask' WHEN focus = 'balanced' THEN 'layered' ELSE 'blur' END AS method FROM (
  SELECT image_id, box_count, objective, CASE WHEN objective IN ('privacy_first', 'failure_avoidance', 'multimodal_risk') THEN 'privacy' WHEN objective = 'utility_priority' THEN 'utility' ELSE 'balanced' END AS focus
  FROM conditions CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{o}'" for o in OBJECTIVES) + """]) AS objective))""")
def _(v):
    from frameops.plans.table_queries import PROFILES

    profiles = v.spark.createDataFrame(PROFILES, "focus string, face_operator string, screen_operator string, text_operator string")
    rows = v.conditions.select("image_id", "box_count", F.explode(F.array(*[F.lit(o) for o in OBJECTIVES])).alias("objective"))
    return D.objective_profile_route(rows, profiles).drop("box_count")


@query("d34_estimate_runtime", """SELECT plan_id, coalesce(exact, latest, 16.0) AS seconds_per_image, coalesce(exact, latest, 16.0) * n_images AS total_seconds,
  CASE WHEN exact IS NOT NULL THEN 'selected_policy' WHEN latest IS NOT NULL THEN 'latest_on_system' ELSE 'hardware_tier' END AS source, CASE WHEN exact IS NOT NULL THEN exact_n WHEN latest IS NOT NULL THEN system_n ELSE 0 END AS sample_count
FROM plans p LEFT JOIN (SELECT gpu_name, policy_id, median(per_image) FILTER (rk <= 5) AS exact, count(*) AS exact_n FROM (SELECT *, row_number() OVER (PARTITION BY gpu_name, policy_id ORDER BY run_time DESC, run_id DESC) AS rk FROM good) GROUP BY ALL) e USING (gpu_name, policy_id)
LEFT JOIN (SELECT gpu_name, arg_max(per_image, {'t': run_time, 'i': run_id}) AS latest, count(*) AS system_n FROM good GROUP BY gpu_name) l USING (gpu_name)""", ctes="""
good AS MATERIALIZED (SELECT event_id AS run_id, epoch(ts) AS run_time, 'gpu' || CAST(user_id % 7 AS VARCHAR) AS gpu_name, event_type AS policy_id, (value * 3 + 20) / (event_id % 90) AS per_image FROM events WHERE event_type <> 'error' AND event_id % 90 >= 10),
plans AS (SELECT c_custkey AS plan_id, 'gpu' || CAST(c_custkey % 9 AS VARCHAR) AS gpu_name, CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'other' END AS policy_id, c_custkey % 50 AS n_images FROM customer)""", dbl="seconds_per_image total_seconds", big="sample_count")
def _(v):
    runs = v.table("events").select(C("event_id").alias("run_id"), C("ts").alias("run_time"), F.concat(F.lit("gpu"), (C("user_id") % 7).cast("string")).alias("gpu_name"),
                                    C("event_type").alias("policy_id"), (C("event_id") % 90).alias("n_images"), (C("value") * 3 + 20).alias("runtime_seconds"), F.when(C("event_type") == "error", 1).otherwise(0).alias("n_errors"))
    plans = v.table("customer").select(C("c_custkey").alias("plan_id"), F.concat(F.lit("gpu"), (C("c_custkey") % 9).cast("string")).alias("gpu_name"),
                                       F.when(C("c_custkey") % 2 == 0, "click").otherwise("other").alias("policy_id"), F.lit("full").alias("tier"), (C("c_custkey") % 50).alias("n_images"))
    tiers = v.spark.createDataFrame([("full", 16.0)], "tier string, estimated_seconds_per_image double")
    return D.estimate_runtime(plans, runs, tiers)


@query("d35_generation_eligibility", """SELECT image_id, concat_ws('|', CASE WHEN single_face <> 1 THEN 'not_single_face' END, CASE WHEN medium_face <> 1 AND large_face <> 1 THEN 'unsupported_face_scale' END, CASE WHEN edge_or_partial_face = 1 THEN 'edge_or_partial_face' END,
  CASE WHEN profile_or_occluded_face = 1 THEN 'profile_or_occluded_face' END, CASE WHEN motion_blur_or_low_sharpness = 1 THEN 'motion_blur_or_low_sharpness' END) AS reasons,
  single_face = 1 AND (medium_face = 1 OR large_face = 1) AND edge_or_partial_face = 0 AND profile_or_occluded_face = 0 AND motion_blur_or_low_sharpness = 0 AS eligible FROM conditions""")
def _(v):
    return D.generation_eligibility(v.conditions).select("image_id", F.array_join("reasons", "|").alias("reasons"), "eligible")


@query("e12_privacy_three_attacker", "SELECT image_id, method, privacy3 AS privacy FROM enh WHERE success = 1 AND box_count > 0", ctes=ENH, dbl="privacy")
def _(v):
    rows = v.scored_metrics.filter((C("success") == 1) & (C("box_count") > 0))
    return rows.select("image_id", "method", D.privacy_three_attacker().alias("privacy"))


@query("e14_face_region_utility", "SELECT image_id, method, 0.35 * ssim + 0.25 * lpips_term + 0.25 * background_preservation + 0.15 * success AS utility FROM scored_metrics", dbl="utility")
def _(v):
    return v.scored_metrics.select("image_id", "method", D.face_region_utility(C("ssim"), C("lpips_term"), C("background_preservation"), C("success")).alias("utility"))


# comparison


#: Tail of Student's t by the continued fraction of the incomplete beta function, one step a row; its critical value by the
#: expansion around the normal one (1.959963984540054), which is exact to twelve digits from a thousand pairs on.
TTEST = """tt AS MATERIALIZED (SELECT method, n, mean_difference, sd / sqrt(n) AS standard_error, mean_difference / (sd / sqrt(n)) AS t, CAST(n - 1 AS DOUBLE) AS df FROM (
  SELECT x.method, count(*) AS n, avg(x.ssim - b.ssim) AS mean_difference, stddev_samp(x.ssim - b.ssim) AS sd FROM method_metrics x JOIN method_metrics b ON b.image_id = x.image_id AND b.method = 'blur' WHERE x.method <> 'blur' AND x.ssim IS NOT NULL AND b.ssim IS NOT NULL GROUP BY x.method)),
swap AS (SELECT *, df / (df + t * t) > (df / 2 + 1) / (df / 2 + 2.5) AS swapped FROM tt),
beta AS MATERIALIZED (SELECT *, CASE WHEN swapped THEN 0.5 ELSE df / 2 END AS a, CASE WHEN swapped THEN df / 2 ELSE 0.5 END AS b, CASE WHEN swapped THEN t * t / (df + t * t) ELSE df / (df + t * t) END AS x FROM swap),
rec_first AS (SELECT method, a, b, x, 1 - (a + b) * x / (a + 1) AS d0 FROM beta),
rec AS (SELECT method, 1 AS m, a, b, x, CAST(1.0 AS DOUBLE) AS c, 1 / d0 AS d, 1 / d0 AS value FROM rec_first
  UNION ALL SELECT method, m + 1, a, b, x, c2, 1 / (1 + odd / e), value * (1 / (1 + even * d)) * c1 * (1 / (1 + odd / e)) * c2 FROM (
    SELECT *, 1 + odd / c1 AS c2, 1 + even * d AS e FROM (
      SELECT *, 1 + even / c AS c1 FROM (
        SELECT *, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) AS even, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS odd FROM rec WHERE m < 200)))),
tail AS (SELECT r.method, exp(lgamma(r.a + r.b) - lgamma(r.a) - lgamma(r.b) + r.a * ln(r.x) + r.b * ln(1 - r.x)) / r.a * value AS i FROM rec r WHERE m = 200),
z AS (SELECT CAST(1.959963984540054 AS DOUBLE) AS z),
crit AS (SELECT method, z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * df ** 3) AS q FROM tt CROSS JOIN z)"""


@query("c01_paired_ttest", """SELECT method, n, mean_difference, standard_error, t, CASE WHEN swapped THEN 1 - i ELSE i END AS p_value,
  mean_difference - q * standard_error AS ci_low, mean_difference + q * standard_error AS ci_high FROM beta JOIN tail USING (method) JOIN crit USING (method)""",
       ctes=TTEST, dbl="mean_difference standard_error t p_value ci_low ci_high")
def _(v):
    base = v.method_metrics.filter(C("method") == "blur").select("image_id", C("ssim").alias("b"))
    rows = v.method_metrics.filter(C("method") != "blur").select("image_id", "method", C("ssim").alias("a")).join(base, "image_id")
    return S.paired_ttest(rows, ["method"])


def cascade_gaps(v):
    e = enhanced(v)
    policy = cascaded(v).select(F.lit("cascade").alias("policy"), "image_id", "score")
    return S.policy_differences(policy, e.select("image_id", "method", C("enhanced_score").alias("score")))


GAPS = ENH + "," + CASCADE + ", gaps AS MATERIALIZED (SELECT c.image_id, e.method AS fixed_method, c.score, e.enhanced_score AS fixed_score, c.score - e.enhanced_score AS difference FROM casc c JOIN enh e USING (image_id))"


@query("c02_paired_bootstrap")
def _(v):
    return S.paired_bootstrap(cascade_gaps(v), ["policy", "fixed_method"], "image_id", "difference", means={"policy_mean": "score", "fixed_mean": "fixed_score"})


@query("c02_policy_means", "SELECT fixed_method, count(*) AS n, avg(score) AS policy_mean, avg(fixed_score) AS fixed_mean, avg(difference) AS mean_difference FROM gaps GROUP BY fixed_method", ctes=GAPS, dbl="policy_mean fixed_mean mean_difference")
def _(v):
    return cascade_gaps(v).groupBy("fixed_method").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("policy_mean"), F.avg("fixed_score").alias("fixed_mean"), F.avg("difference").alias("mean_difference"))


@query("c03_win_tie_loss", "SELECT fixed_method, count(*) FILTER (difference > 1e-12) AS wins, count(*) FILTER (difference < -1e-12) AS losses, count(*) FILTER (abs(difference) <= 1e-12) AS ties FROM gaps GROUP BY fixed_method", ctes=GAPS)
def _(v):
    return S.win_tie_loss(cascade_gaps(v), ["fixed_method"])


@query("c04_compare_to_reference", """SELECT m.method, b.privacy_score - m.privacy_score AS privacy_score_delta, CASE WHEN b.privacy_score - m.privacy_score > 1e-12 THEN 'win' WHEN b.privacy_score - m.privacy_score < -1e-12 THEN 'loss' ELSE 'tie' END AS privacy_score_result
FROM mt m CROSS JOIN (SELECT privacy_score FROM mt WHERE method = 'blur') b""", ctes=METHOD_TABLE, dbl="privacy_score_delta")
def _(v):
    return S.compare_to_reference(method_table(v), "method", "blur", ["privacy_score"]).select("method", "privacy_score_delta", "privacy_score_result")


@query("c05_best_competitor", """SELECT m.subgroup, m.composite AS own_score, b.source AS competitor, b.composite AS competitor_score, m.composite - b.composite AS margin FROM sub_scores m
JOIN (SELECT *, row_number() OVER (PARTITION BY subgroup ORDER BY composite DESC, source) AS rk FROM sub_scores WHERE source <> 'yolo') b ON b.subgroup = m.subgroup AND b.rk = 1 WHERE m.source = 'yolo'""", ctes=SUBGROUP, dbl="own_score competitor_score margin")
def _(v):
    return S.best_competitor(subgroup_scores(v), "subgroup", "source", "yolo", "composite")


@query("c06_category_vs_fixed", "SELECT g.subgroup AS category, fixed_method, count(*) AS n, avg(score) AS policy_mean, avg(fixed_score) AS fixed_mean, avg(difference) AS mean_difference FROM gaps JOIN membership g USING (image_id) WHERE g.subgroup <> 'overall' GROUP BY ALL", ctes=GAPS, dbl="policy_mean fixed_mean mean_difference")
def _(v):
    e = enhanced(v)
    policy = cascaded(v).select(F.lit("cascade").alias("policy"), "image_id", "score")
    return S.category_vs_fixed(policy, e.select("image_id", "method", C("enhanced_score").alias("score")), member(v))


@query("c07_wilson_interval", """SELECT method, s AS successes, n, p AS share, mid - half AS ci_low, mid + half AS ci_high FROM (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n) AS half FROM (
  SELECT method, count(*) FILTER (reid_a > 0.5) AS s, count(*) AS n, CAST(count(*) FILTER (reid_a > 0.5) AS DOUBLE) / count(*) AS p, CAST(1.959963984540054 AS DOUBLE) AS z FROM method_metrics GROUP BY method))""", dbl="share ci_low ci_high")
def _(v):
    rows = v.method_metrics.groupBy("method").agg(F.count_if(C("reid_a") > 0.5).alias("successes"), F.count(F.lit(1)).alias("n"))
    return R.wilson_interval(rows, "successes", "n")


@query("c08_objective_wins", """SELECT l.objective_mode, count(*) FILTER (l.p > m.privacy_score + 1e-12) AS privacy_score_wins, count(*) FILTER (l.p < m.privacy_score - 1e-12) AS privacy_score_losses, count(*) FILTER (abs(l.p - m.privacy_score) <= 1e-12) AS privacy_score_ties
FROM (SELECT objective_mode, avg(CASE WHEN category = 'no_face' THEN 1.0 ELSE privacy_score END) AS p FROM plog g LEFT JOIN scored_metrics s ON s.image_id = g.image_id AND s.method = g.selected_method GROUP BY objective_mode) l CROSS JOIN mt m GROUP BY l.objective_mode""", ctes=CHOICES + "," + METHOD_TABLE)
def _(v):
    routed = policy_log(v).groupBy("objective_mode").agg(F.avg("actual_privacy_score").alias("privacy_score"))
    return R.objective_wins(routed, method_table(v), ["privacy_score"])


@query("c09_integrated_vs_fixed", """SELECT policy, sum(n) AS n_input_frames, sum(s) / sum(n) AS mean_score, string_agg(method || '=' || CAST(n AS VARCHAR), ',' ORDER BY method) AS method_distribution, sum(s) / sum(n) - (SELECT avg(score) FROM casc) AS score_difference FROM (
  SELECT 'cascade' AS policy, selected_method AS method, count(*) AS n, sum(score) AS s FROM casc GROUP BY ALL UNION ALL SELECT 'fixed_' || method, method, count(*), sum(enhanced_score) FROM enh GROUP BY ALL) GROUP BY policy""", ctes=ENH + "," + CASCADE, dbl="mean_score score_difference", big="n_input_frames")
def _(v):
    e = enhanced(v)
    policy = cascaded(v).select("image_id", C("selected_method").alias("method"), "score")
    out = R.integrated_vs_fixed(policy, e.select("image_id", "method", C("enhanced_score").alias("score")), "cascade")
    text = F.array_join(F.transform(F.map_entries("method_distribution"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.withColumn("method_distribution", text)


