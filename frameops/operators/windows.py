"""Ranking and selection operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.operators.scale import GROUP_LIMIT, exact_quantiles, null_safe_join, running_totals, top_k


def dense_rank_scores(rows: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Dense rank, best first, of every score within its category.

    Runs on aggregated rows: a category holds one row per method.
    """
    return rows.withColumns({
        f"{s}_rank": F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(s).desc())) for s in scores})


def best_and_second(rows: DataFrame, keys: Sequence[str], model: str = "model", score: str = "composite") -> DataFrame:
    """Best row per key by (score, recall, f1, precision), the runner-up and the margin."""
    order = [F.col(c).desc() for c in (score, "recall", "f1", "precision")] + [F.col(model)]
    window = Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumns({
        "rank": F.row_number().over(window), "second_model": F.lead(model).over(window),
        "second_score": F.lead(score).over(window)})
    return out.filter(F.col("rank") == 1).drop("rank").withColumn("margin", F.col(score) - F.col("second_score"))


def quantile_label(df: DataFrame, value: str, key: str, labels: Sequence[str] = ("low", "medium", "high"),
                   name: str = "level", limit: int = GROUP_LIMIT) -> DataFrame:
    """Three equal bins by rank, ties in key order.

    rank r of n is low when 3(r-1) <= n-1, medium when 3(r-1) <= 2(n-1), else high.
    """
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_totals(df, [], [F.col(value), F.col(key)], {"__r": F.lit(1)}, limit)
    out = ranked.crossJoin(F.broadcast(total))
    at, last = 3 * (F.col("__r") - 1), F.col("__n") - 1
    label = F.when(at <= last, labels[0]).when(at <= 2 * last, labels[1]).otherwise(labels[2])
    return out.withColumn(name, label).drop("__r", "__n")


def low_quantile_flag(df: DataFrame, value: str, q: float = 0.25, name: str = "flag", limit: int = GROUP_LIMIT) -> DataFrame:
    """Value at or below its ``q`` quantile over all rows."""
    cut = exact_quantiles(df.select(value), [], value, {"__q": q}, limit)
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.col(value) <= F.col("__q")).drop("__q")


def pct_dense_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "label_confidence") -> DataFrame:
    """Dense rank (best first) over the number of distinct values, three decimals.

    Ranks are taken over the distinct values and joined back, so repeated values cost nothing.
    """
    keys = list(keys)
    distinct = df.select(*keys, value).distinct()
    n = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_totals(distinct, keys, [F.col(value).desc()], {"__r": F.lit(1)})
    ranked = null_safe_join(ranked, n, keys) if keys else ranked.crossJoin(F.broadcast(n))
    share = F.round(F.col("__r") / F.col("__n"), 3).alias(name)
    return null_safe_join(df, ranked.select(*keys, value, share), [*keys, value])


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global top rows; Spark keeps n rows per task and merges them."""
    return df.orderBy(*order).limit(n)


def head_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group."""
    return top_k(df, keys, order, k)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (reverse it to keep the last)."""
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def winners_by_metric(rows: DataFrame, keys: Sequence[str], model: str, metrics: Sequence[str]) -> DataFrame:
    """The winning model per metric, ties to the larger name."""
    return rows.groupBy(*keys).agg(*[
        F.max_by(model, F.struct(F.col(m), F.col(model))).alias(f"best_by_{m}") for m in metrics])


def richest_source_wins(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables where a later table replaces earlier rows of the same key."""
    tagged = None
    for i, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return keep_one(tagged, keys, [F.col("__source").desc()]).drop("__source")
