"""Operators known only from retained result tables; their formulas are reconstructions
(A22-A25, C07-C09, D28-D32, E06-E08)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.lineage import cut
from frameops.operators.policy import NO_ACTION, eligible_ranking, safety_gates
from frameops.operators.scale import GROUP_LIMIT, running_totals
from frameops.operators.windows import keep_one


def failure_rates(rows: DataFrame, column: str = "residual_classes") -> DataFrame:
    """Frames per residual class (pipe-joined; none as NONE) and their share of all frames."""
    classes = F.split(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("NONE")), r"\|")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = rows.select(F.explode(classes).alias("failure_class")).groupBy("failure_class").agg(F.count(F.lit(1)).alias("frame_count"))
    return out.crossJoin(F.broadcast(total)).withColumn("rate", F.col("frame_count") / F.col("total"))


def residual_summary(rows: DataFrame, flags: Sequence[str], keys: Sequence[str] = (), near_zero: float = 0.01) -> DataFrame:
    """Mean of flag columns and share of near-zero privacy."""
    any_flag = reduce(lambda a, b: a | b, [F.col(f) for f in flags])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"), *[F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags],
        F.avg(any_flag.cast("double")).alias("any_flag_rate"), F.avg("privacy_score").alias("mean_privacy"),
        F.avg("utility_score").alias("mean_utility"), F.avg((F.col("privacy_score") <= near_zero).cast("double")).alias("privacy_near_zero_rate"))


def review_field_counts(rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(field, value) counts of review columns."""
    long = rows.unpivot(list(keys), list(fields), "field", "value")
    return long.groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("count"))


def adjudicate(first: DataFrame, second: DataFrame, key: str, privacy: Mapping[str, Sequence[str]], utility: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows where two passes disagree, with the conservative value.

    Levels are listed from low to high: privacy fields take the higher, utility fields the lower.
    """
    fields = [*privacy, *utility]
    a = first.unpivot([key], fields, "field", "pass_1")
    b = second.unpivot([key], fields, "field", "pass_2")
    rows = a.join(b, [key, "field"]).filter(F.col("pass_1") != F.col("pass_2"))
    final = F
    for field, levels in {**privacy, **utility}.items():
        scale = F.array(*[F.lit(v) for v in levels])
        p, q = F.array_position(scale, F.col("pass_1")), F.array_position(scale, F.col("pass_2"))
        chosen = F.greatest(p, q) if field in privacy else F.least(p, q)
        final = final.when(F.col("field") == field, F.get(scale, (chosen - 1).cast("int")))
    return rows.withColumn("final", final)


def wilson_interval(rows: DataFrame, successes: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """Wilson score interval of a share."""
    p, m = F.col(successes) / F.col(n), F.col(n).cast("double")
    bottom = 1 + z * z / m
    middle = (p + z * z / (2 * m)) / bottom
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / bottom
    return rows.withColumns({"share": p, "ci_low": middle - half, "ci_high": middle + half})


def objective_wins(routed: DataFrame, fixed: DataFrame, higher: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Wins, losses and ties of every objective against the fixed methods, per metric (higher is better)."""
    right = fixed.select(*[F.col(m).alias(f"fixed_{m}") for m in higher])
    rows = routed.crossJoin(F.broadcast(right))
    counts = []
    for m in higher:
        gap = F.col(m) - F.col(f"fixed_{m}")
        counts += [F.count_if(gap > tolerance).alias(f"{m}_wins"), F.count_if(gap < -tolerance).alias(f"{m}_losses"),
                   F.count_if(F.abs(gap) <= tolerance).alias(f"{m}_ties")]
    return rows.groupBy("objective_mode").agg(*counts)


def integrated_vs_fixed(policy: DataFrame, metrics: DataFrame, name: str = "integrated_policy") -> DataFrame:
    """One policy beside every fixed method, score difference to the policy and method distribution.

    ``policy``: image_id, method, score.  ``metrics``: the same columns for all methods.
    """
    rows = policy.select(F.lit(name).alias("policy"), "method", "score").unionByName(
        metrics.select(F.concat(F.lit("fixed_"), "method").alias("policy"), "method", "score"))
    per_method = rows.groupBy("policy", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    out = per_method.groupBy("policy").agg(
        F.sum("n").alias("n_input_frames"), (F.sum("s") / F.sum("n")).alias("mean_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("method_distribution"))
    base = out.filter(F.col("policy") == name).select(F.col("mean_score").alias("base"))
    return out.crossJoin(F.broadcast(base)).withColumn("score_difference", F.col("mean_score") - F.col("base")).drop("base")


def risk_state_policy(variants: DataFrame) -> DataFrame:
    """Per predicted risk state the best development score, privacy breaking ties; no risk means no action.

    ``variants``: risk_state, variant, score, privacy, utility.
    """
    best = keep_one(variants, ["risk_state"], [F.col("score").desc(), F.col("privacy").desc(), F.col("variant")])
    idle = F.col("risk_state") == "no_text_screen_risk"
    return best.select("risk_state", F.when(idle, NO_ACTION).otherwise(F.col("variant")).alias("selected_variant"),
                       *[F.when(~idle, F.col(c)).alias(c) for c in ("score", "privacy", "utility")])


def soft_floor_policy(variants: DataFrame, floor: float = 0.80) -> DataFrame:
    """Highest utility per risk state among variants at or above the privacy floor."""
    rows = variants.filter((F.col("privacy") >= floor) & (F.col("risk_state") != "no_text_screen_risk"))
    return keep_one(rows, ["risk_state"], [F.col("utility").desc(), F.col("score").desc(), F.col("variant")])


def residual_ledger(rows: DataFrame, classes: Sequence[tuple[str, Column]]) -> DataFrame:
    """Pipe-joined residual classes per frame and its disposition."""
    joined = F.concat_ws("|", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in classes])))
    out = rows.withColumn("residual_classes", joined)
    missed = F.col("residual_classes").contains("missed_")
    return out.withColumn("disposition", F.when(F.col("residual_classes") == "", "clear").when(missed, "detector_residual").otherwise("localisation_or_ocr_residual"))


def oracle_selector(methods: DataFrame, objectives: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Best method per objective; objectives map to (column, "min" or "max")."""
    picks = []
    for name, (column, sense) in objectives.items():
        sign = 1 if sense == "min" else -1
        picks.append(F.struct(F.lit(name).alias("objective"),
                              F.min_by("method", F.struct((F.col(column) * sign).alias("v"), "method")).alias("oracle_method")))
    return methods.agg(F.array(*picks).alias("p")).select(F.inline("p"))


def ablation_table(methods: DataFrame, score: str, components: Mapping[str, Sequence[str]]) -> DataFrame:
    """The winner with all gates and with single gates removed."""
    parts = []
    for name, skip in components.items():
        ranked = eligible_ranking(safety_gates(methods, skip=skip), score)
        top = ranked.filter((F.col("ranking") == "eligible") & (F.col("place") == 1))
        parts.append(top.select(F.lit(name).alias("ablation"), F.lit("|".join(skip) or "none").alias("removed"), "method", score, "mean_max_reid",
                                (F.col("visual_eligibility") == "ELIGIBLE").alias("visual_safe")))
    return reduce(DataFrame.unionByName, parts)


def crossview_by_method(similarity: DataFrame, control: DataFrame, original: str = "original") -> DataFrame:
    """Mean best cosine per method, its delta to the originals and its gap to the mismatched-time control."""
    means = similarity.groupBy("method").agg(F.count(F.lit(1)).alias("pairs"), F.avg("similarity").alias("mean_similarity"))
    other = control.groupBy("method").agg(F.avg("similarity").alias("control_similarity"))
    base = means.filter(F.col("method") == original).select(F.col("mean_similarity").alias("base"))
    out = means.join(other, "method", "left").crossJoin(F.broadcast(base))
    return out.select("method", "pairs", "mean_similarity", (F.col("mean_similarity") - F.col("base")).alias("delta_vs_original"),
                      (F.col("mean_similarity") - F.col("control_similarity")).alias("gap_vs_control"))


def verification_metrics(scores: DataFrame, keys: Sequence[str] = ("method",), limit: int = GROUP_LIMIT) -> DataFrame:
    """AUC, equal error rate and acceptance rates at fixed false acceptance, per key.

    ``scores``: keys, similarity, positive (0/1).  Equal similarities are merged
    once; everything follows from counts over the distinct values.
    """
    keys = list(keys)
    c = F.col
    merged = cut(scores.groupBy(*keys, "similarity").agg(F.sum("positive").alias("p"), F.sum(1 - c("positive")).alias("q")))
    totals = merged.groupBy(*keys).agg(
        F.sum("p").alias("np"), F.sum("q").alias("nq"), F.try_divide(F.sum(c("similarity") * c("p")), F.sum("p")).alias("mp"),
        F.try_divide(F.sum(c("similarity") * c("q")), F.sum("q")).alias("mq"))
    run = running_totals(merged, keys, [c("similarity").desc()], {"tp": c("p"), "fp": c("q")}, limit)
    run = run.join(totals, keys) if keys else run.crossJoin(F.broadcast(totals))
    far, frr = c("fp") / c("nq"), 1 - c("tp") / c("np")
    # a negative is beaten by the positives above it and half of those beside it
    area = F.sum(c("q") * (c("tp") - c("p") / 2)) / (F.first("np") * F.first("nq"))
    closest = F.struct(F.round(F.abs(far - frr), 12).alias("gap"), c("similarity"))
    spread = lambda n, mean: F.sqrt(F.try_divide(F.sum(c(n) * F.pow(c("similarity") - c(mean), 2)), F.sum(n)))
    return run.groupBy(*keys).agg(
        F.first("np").alias("positive_pairs"), F.first("nq").alias("negative_pairs"), area.alias("auc"),
        F.min_by((far + frr) / 2, closest).alias("eer"),
        *[F.coalesce(F.max(F.when(far <= t, c("tp") / c("np"))), F.lit(0.0)).alias(f"tar_at_far_{n}") for n, t in (("10", 0.10), ("05", 0.05))],
        F.first("mp").alias("mean_positive"), F.first("mq").alias("mean_negative"), spread("p", "mp").alias("std_positive"), spread("q", "mq").alias("std_negative"))


def pair_accounting(pairs: DataFrame) -> DataFrame:
    """Totals, evaluable and skipped pairs and the reasons as a map.  ``pairs`` has skip_reason (null = evaluable)."""
    reasons = pairs.filter(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    table = reasons.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("skip_reason", "n")))).alias("reasons"))
    return pairs.agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if(F.col("skip_reason").isNull()).alias("evaluable_pairs"),
                     F.count("skip_reason").alias("skipped_pairs")).crossJoin(F.broadcast(table))
