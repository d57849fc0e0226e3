"""Skew-safe building blocks shared by the operators.

A key may hold a large share of all rows.  Every helper here either reduces a
hot group before the shuffle, or splits it over many tasks, and always returns
the exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.lineage import cut, shuffles_removed

# Groups above this many rows are not handled inside one task.
GROUP_LIMIT = 2_000_000
# A table is broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 100_000
# Spark cuts ranks before the shuffle up to this bound (spark.sql.optimizer.windowGroupLimitThreshold).
CUT_RANK = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    One aggregation that reads only the key columns.  The result has at most
    rows/limit rows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    with shuffles_removed(df.sparkSession):
        found = counted.select(*keys).take(BROADCAST_ROWS + 1)
    if not found:
        return None
    if len(found) > BROADCAST_ROWS:
        return counted.select(*keys)
    return F.broadcast(df.sparkSession.createDataFrame(found, df.select(*keys).schema))


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot keys; a null key may be hot too."""
    return null_safe_join(df, hot, keys, "left_anti"), null_safe_join(df, hot, keys, "left_semi")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the keys of ``right`` are dropped."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    joined = left.join(named, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys], how)
    return joined.drop(*[f"__right_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting that it is small; otherwise leave it to AQE."""
    return F.broadcast(df) if len(df.take(limit + 1)) <= limit else df


def unsized(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input and is never broadcast.

    Spark estimates a side from the bytes of its files, which are compressed and
    count an exploded row once, and would collect it on the driver.
    """
    return df.hint("merge")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Up to ``CUT_RANK`` a literal bound on the rank lets Spark cut each map task's output to
    ``k`` rows per key before the shuffle. Larger ranks are running counts, which split a hot key by ranges.
    Either way a hot key cannot fill one task.
    """
    if k > CUT_RANK:
        return running_totals(df, keys, order, {rank: F.lit(1)}).filter(F.col(rank) <= F.lit(k))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= F.lit(k))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    limit: int = GROUP_LIMIT,
    at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` within ``group``.

    ``at_most`` is a proven bound on the rows of one group, when the caller has
    a cheaper one than counting ``df``.

    Groups of a checked size use one window.  A larger group is range
    partitioned by its order, summed inside each range, and shifted by the
    totals of the ranges before it.
    """
    df = df.withColumns({f"__v_{name}": value for name, value in sums.items()})
    if at_most is not None and at_most <= limit:
        cold, large = df, None
    elif group:
        hot = hot_keys(df, group, limit)
        if hot is None:
            cold, large = df, None
        else:
            cold, large = split_hot(df, group, hot)
    else:
        is_large = len(df.select(F.lit(1)).take(limit + 1)) > limit
        cold, large = (None, df) if is_large else (df, None)

    parts = []
    if cold is not None:
        window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts.append(cold.withColumns({name: F.sum(f"__v_{name}").over(window) for name in sums}))
    if large is not None:
        ranged = large.repartitionByRange(*[F.col(g) for g in group], *order)
        ranged = cut(ranged.withColumn("__part", F.spark_partition_id()))
        keys = ["__part", *group]
        totals = ranged.groupBy(*keys).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
        before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *keys, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
        )
        inside = Window.partitionBy(*keys).orderBy(*order)
        inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shifted = null_safe_join(ranged, offsets, keys).withColumns(
            {n: F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside) for n in sums}
        )
        parts.append(shifted.drop("__part", *[f"__o_{n}" for n in sums]))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.drop(*[f"__v_{n}" for n in sums])


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float], limit: int = GROUP_LIMIT
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per named probability.

    Equal values are merged before the shuffle.  Groups of a checked size use
    the built-in aggregate; larger ones read the two neighbouring ranks off
    distributed running counts.
    """
    rows = df.filter(F.col(value).isNotNull())
    keys = list(by)
    if not keys:
        rows, keys = rows.withColumn("__all", F.lit(1)), ["__all"]
    hot = hot_keys(rows, keys, limit)
    cold, large = (rows, None) if hot is None else split_hot(rows, keys, hot)
    out = cold.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p)).alias(name) for name, p in probabilities.items()]
    )
    if large is not None:
        merged = large.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
        placed = running_totals(merged, keys, [F.col(value)], {"__cum": F.col("__c")}, limit)
        sizes = merged.groupBy(*keys).agg(F.sum("__c").alias("__n"))
        placed = null_safe_join(placed, sizes, keys)
        picks = []
        for name, p in probabilities.items():
            at = (F.col("__n") - 1) * F.lit(p)

            def value_at(rank: Column) -> Column:
                covers = (F.col("__cum") > rank) & (F.col("__cum") - F.col("__c") <= rank)
                return F.max(F.when(covers, F.col(value)))

            low, high = value_at(F.floor(at)), value_at(F.ceil(at))
            part = F.max(at - F.floor(at))
            picks.append((low + (high - low) * part).alias(name))
        out = out.unionByName(placed.groupBy(*keys).agg(*picks))
    return out if by else out.drop("__all")
