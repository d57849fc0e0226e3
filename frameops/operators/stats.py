"""Paired comparison and statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.operators.windows import keep_one


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / (1.0 + even * d), 1.0 + even / c
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / (1.0 + odd * d), 1.0 + odd / c
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return _beta_tail(df / 2.0, 0.5, df / (df + t * t))


def student_critical(df: float, alpha: float = 0.05) -> float:
    """Two-sided critical value, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if student_tail(middle, df) > alpha else (low, middle)
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_tail(a, b) if a == a and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t_critical(df: pd.Series) -> pd.Series:
    return df.map(lambda n: student_critical(n) if n > 0 else None).astype("float64")


def paired_ttest(rows: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Paired t statistic, p-value and 95 % interval of the mean difference, complete pairs only.

    The sums are distributed; tail and critical value are computed on the result rows.
    """
    gap = F.col(a) - F.col(b)
    sums = rows.filter(gap.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean_difference"), F.stddev_samp(gap).alias("sd"))
    error = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    out = sums.withColumn("standard_error", error)
    out = out.withColumn("t", F.try_divide("mean_difference", "standard_error"))
    df = (F.col("n") - 1).cast("double")
    out = out.withColumn("p_value", _t_p_value(F.col("t"), df))
    half = _t_critical(df) * F.col("standard_error")
    return out.withColumns({"ci_low": F.col("mean_difference") - half, "ci_high": F.col("mean_difference") + half}).drop("sd")


def win_tie_loss(rows: DataFrame, keys: Sequence[str] = (), difference: str = "difference", tolerance: float = 1e-12) -> DataFrame:
    """Counts with a tolerance for ties."""
    return rows.groupBy(*keys).agg(*_win_tie_loss(difference, tolerance))


def _win_tie_loss(difference: str, tolerance: float = 1e-12) -> list[Column]:
    d = F.col(difference)
    return [F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties")]


#: Resamples of one block of weights, and cells of weights (cases x resamples) that a task holds.
RESAMPLE_BLOCK, WEIGHT_CELLS = 500, 2_000_000
#: Weights drawn at a time, and tasks that share the draws, per core.
CACHE_CELLS, TASKS_PER_CORE = 32_768, 3


def _poisson_limits() -> np.ndarray:
    """Shares below which a uniform gives 0, 1, 2, ...: inversion of Poisson(1); the tail beyond 18 is below 53 bits."""
    terms = np.cumprod(np.concatenate([[math.exp(-1.0)], 1.0 / np.arange(1, 18)]))
    return np.cumsum(terms)


def _weight_table() -> np.ndarray:
    """Weight by the upper 16 bits of a draw; 255 where a limit lies inside, so that more bits decide."""
    at = np.arange(65536)
    low, high = (np.searchsorted(_poisson_limits(), x, "right") for x in (at / 65536, (at * 2.0**37 + (2.0**37 - 1)) / 2.0**53))
    return np.where(low == high, low, 255).astype(np.uint8)


def poisson_weights(cases: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Poisson(1) weights of cases (64-bit hashes) in resamples ``start`` to ``stop``, cases x resamples.

    Draws are made in pieces that stay in a core's cache, and most of them are looked up by their upper bits.
    """
    steps = np.arange(start + 1, stop + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table, limits, cases = _weight_table(), _poisson_limits(), cases.astype(np.uint64)
    out = np.empty((len(cases), stop - start))
    rows = max(1, CACHE_CELLS // max(stop - start, 1))
    draws, shifted = np.empty((2, rows, stop - start), np.uint64)
    for i in range(0, len(cases), rows):
        part = cases[i : i + rows, None]
        z, t = draws[: len(part)], shifted[: len(part)]
        np.add(part, steps, out=z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.bitwise_xor(z, np.right_shift(z, np.uint64(shift), out=t), out=z)
            np.multiply(z, np.uint64(factor), out=z)
        weights = table[np.right_shift(z, np.uint64(48), out=t).view(np.int64)]
        out[i : i + rows] = weights
        case, resample = np.nonzero(weights == 255)
        out[i + case, resample] = np.searchsorted(limits, (z[case, resample] >> np.uint64(11)) / 2.0**53, "right")
    return out


def _resampled_sums(keys: list[str], resamples: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key and block of resamples, sums of weights and of weighted values over a task's rows."""
    totals: dict[tuple, np.ndarray] = {}
    for batch in batches:
        frame = batch.to_pandas()
        if frame.empty:
            continue
        group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(frame), np.int64)
        names = [tuple(x) for x in frame.loc[~pd.Series(group).duplicated().to_numpy(), keys].itertuples(index=False)] if keys else [()]
        names = [tuple(None if pd.isna(x) else x for x in name) for name in names]
        cases, case = np.unique(frame["__case"].to_numpy(), return_inverse=True)
        values = np.stack([np.ones(len(frame)), frame["__v"].to_numpy()])
        for name in names:
            totals.setdefault(name, np.zeros((2, resamples)))
        for low in range(0, resamples, RESAMPLE_BLOCK):
            high = min(resamples, low + RESAMPLE_BLOCK)
            for first in range(0, len(cases), WEIGHT_CELLS // RESAMPLE_BLOCK):
                last = first + WEIGHT_CELLS // RESAMPLE_BLOCK
                weights = poisson_weights(cases[first:last], low, high)
                inside = np.flatnonzero((case >= first) & (case < last))
                # rows of one case share its draws, and those of all keys are added up in one product
                place, n = group[inside] * len(weights) + case[inside] - first, len(names) * len(weights)
                per_case = np.concatenate([np.bincount(place, v[inside], n).reshape(len(names), -1) for v in values])
                sums = (per_case @ weights).reshape(2, len(names), -1)
                for g, name in enumerate(names):
                    totals[name][:, low:high] += sums[:, g]
    starts = range(0, resamples, RESAMPLE_BLOCK)
    for name, sums in totals.items():
        columns = [pa.array([x] * len(starts), batch.schema.field(k).type) for k, x in zip(keys, name)]
        columns += [pa.array(list(starts), pa.int32())] + [pa.array([s[i : i + RESAMPLE_BLOCK] for i in starts], pa.list_(pa.float64())) for s in sums]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "start", "w", "s"])


def _added(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one key and block, which come one after another, added up."""
    at, row, total = None, None, None

    def out() -> pa.RecordBatch:
        columns = [row[k] for k in [*keys, "start"]]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([t], pa.list_(pa.float64())) for t in total]], names=[*keys, "start", "w", "s"])

    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            name = tuple(one[k][0].as_py() for k in [*keys, "start"])
            vectors = np.stack([one["w"].flatten().to_numpy(), one["s"].flatten().to_numpy()])
            if name == at:
                total = total + vectors
                continue
            if at is not None:
                yield out()
            at, row, total = name, one, vectors
    if at is not None:
        yield out()


def bootstrap_means(rows: DataFrame, keys: Sequence[str], case: str, value: str, resamples: int = 10_000, seed: int = 20260712) -> DataFrame:
    """Resampled means per key: one row per (key, resample).

    Case weights are Poisson(1) draws from a hash of (seed, case) and the resample, made per block inside the task that holds
    the row: a task returns two vectors per key and block, and those are added up.  Cases are dealt to all cores by number, as
    Spark would deal these few bytes to few tasks, and rows of a case lie together, so that its draws are made once.  Poisson
    weights stand in for multinomial ones; intervals agree statistically, not digit by digit.
    """
    keys = list(keys)
    source = rows.select(*keys, F.xxhash64(F.lit(seed), F.col(case)).alias("__case"), F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    source = source.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, "__case").sortWithinPartitions("__case")
    out = T.StructType([source.schema[k] for k in keys] + T.StructType.fromDDL("start int, w array<double>, s array<double>").fields)
    parts = source.mapInArrow(lambda it: _resampled_sums(keys, resamples, it), out).repartition(*keys, "start").sortWithinPartitions(*keys, "start")
    packed = parts.mapInArrow(lambda it: _added(keys, it), out)
    pairs = F.arrays_zip("w", "s")
    means = packed.select(*keys, "start", F.posexplode(pairs).alias("i", "p"))
    return means.select(*keys, (F.col("start") + F.col("i")).alias("resample"), F.try_divide("p.s", "p.w").alias("mean"))


def paired_bootstrap(rows: DataFrame, keys: Sequence[str], case: str, difference: str, resamples: int = 10_000, seed: int = 20260712,
                     means: Mapping[str, str] | None = None) -> DataFrame:
    """Mean difference with a 95 % bootstrap interval and win/loss/tie counts per key.

    ``means`` adds plain means: result column by input column.
    """
    sampled = bootstrap_means(rows, keys, case, difference, resamples, seed)
    bounds = sampled.groupBy(*keys).agg(F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(difference).alias("mean_difference"), *[F.avg(c).alias(n) for n, c in (means or {}).items()],
        *_win_tie_loss(difference))
    counts = ["wins", "losses", "ties"]
    out = base.join(bounds, list(keys)) if keys else base.crossJoin(bounds)
    return out.select(*[c for c in out.columns if c not in counts], *counts)


def policy_differences(policies: DataFrame, fixed: DataFrame) -> DataFrame:
    """C02 input: score difference of every policy row to every fixed method on the same case (missing counts 0).

    ``policies``: policy, image_id, score.  ``fixed``: image_id, method, score.
    """
    right = fixed.select("image_id", F.col("method").alias("fixed_method"), F.col("score").alias("fixed_score"))
    joined = policies.join(right, "image_id")
    return joined.withColumn("difference", F.col("score") - F.coalesce("fixed_score", F.lit(0.0)))


def compare_to_reference(rows: DataFrame, name: str, reference: str, metrics: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Per row and metric the difference of the reference row, with a win, tie or loss."""
    base = rows.filter(F.col(name) == reference).select(*[F.col(m).alias(f"__{m}") for m in metrics])
    out = rows.crossJoin(F.broadcast(base.limit(1)))
    for m in metrics:
        gap = F.col(f"__{m}") - F.col(m)
        out = out.withColumns({f"{m}_delta": gap, f"{m}_result": F.when(gap > tolerance, "win").when(gap < -tolerance, "loss").otherwise("tie")})
    return out.drop(*[f"__{m}" for m in metrics])


def best_competitor(rows: DataFrame, key: str, model: str, own: str, score: str) -> DataFrame:
    """Per key the best other model and the margin of our own; without one, not_available."""
    mine = rows.filter(F.col(model) == own).select(key, F.col(score).alias("own_score"))
    others = keep_one(rows.filter(F.col(model) != own), [key], [F.col(score).desc(), F.col(model)])
    out = mine.join(others.select(key, F.col(model).alias("competitor"), F.col(score).alias("competitor_score")), key, "left")
    return out.withColumns({"margin": F.col("own_score") - F.col("competitor_score"), "competitor": F.coalesce("competitor", F.lit("not_available"))})


def category_vs_fixed(policy: DataFrame, fixed: DataFrame, membership: DataFrame) -> DataFrame:
    """Mean difference per category and fixed method on the category's frames."""
    rows = policy_differences(policy, fixed).join(membership, "image_id")
    return rows.groupBy("category", "fixed_method").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("policy_mean"), F.avg("fixed_score").alias("fixed_mean"),
        F.avg("difference").alias("mean_difference"))
