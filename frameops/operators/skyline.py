"""Skyline (Pareto front) of large groups without comparing rows pair by pair.

Dominance is decided by divide and conquer on arrays: rows are sorted lexicographically, so that only rows of the first half can
dominate rows of the second, and the second half is filtered by the first on one metric less; with two metrics left that is one
sort and a running maximum. Partitions reduce their rows to local fronts, the strongest rows of each group remove most of what is
left, and fronts meet in ever fewer buckets of bounded size. A group whose front alone exceeds a task is checked a last time
between blocks of its order, and only between blocks whose extremes allow dominance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.lineage import cut
from frameops.operators.scale import broadcast_if_small, null_safe_join, running_totals, top_k

#: Rows of one group that a task compares, rows of a chunk of local fronts, strongest rows per group, pairs of a direct comparison.
TASK_ROWS, CHUNK_ROWS, STRONGEST, DIRECT = 200_000, 100_000, 32, 20_000


def dominated(best: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of ``rows`` have some row of ``best`` at least as large in every column."""
    hit = np.zeros(len(rows), bool)
    if not len(best) or not len(rows):
        return hit
    width = rows.shape[1]
    if width == 0:
        return ~hit
    if width == 1:
        return rows[:, 0] <= best[:, 0].max()
    if width == 2:
        order = np.argsort(-best[:, 0], kind="stable")
        most = np.maximum.accumulate(best[order, 1])
        reached = np.searchsorted(-best[order, 0], -rows[:, 0], "right")
        hit[reached > 0] = most[reached[reached > 0] - 1] >= rows[reached > 0, 1]
        return hit
    if len(best) * len(rows) <= DIRECT:
        return (best[:, None] >= rows[None]).all(2).any(0)
    last = np.concatenate([best[:, -1], rows[:, -1]])
    middle = np.partition(last, len(last) // 2)[len(last) // 2]
    if last.min() == middle:
        # at least half are equal to the least: the others stand above them
        above, upper = best[:, -1] > middle, rows[:, -1] > middle
    else:
        above, upper = best[:, -1] >= middle, rows[:, -1] >= middle
    if last.min() == last.max():
        return dominated(best[:, :-1], rows[:, :-1])
    hit[upper] = dominated(best[above], rows[upper])
    hit[~upper] = dominated(best[above][:, :-1], rows[~upper][:, :-1])
    left = np.flatnonzero(~upper & ~hit)
    hit[left] = dominated(best[~above], rows[left])
    return hit


def front(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the rows that no other row of their group is at least as large as everywhere and larger somewhere."""
    order = np.lexsort([-values[:, i] for i in reversed(range(values.shape[1]))] + [-group])
    # equal groups are asked for by one more column: the group falls along the order, so it must not fall further
    table = np.column_stack([-group, values])[order]
    same = np.zeros(len(table), bool)
    same[1:] = (table[1:] == table[:-1]).all(1)
    first = np.flatnonzero(~same)

    def best(low: int, high: int) -> np.ndarray:
        if high - low <= 1:
            return first[low:high]
        middle = (low + high) // 2
        upper, lower = best(low, middle), best(middle, high)
        return np.concatenate([upper, lower[~dominated(table[upper], table[lower])]])

    kept = best(0, len(first))
    # repeats of a kept row are kept with it
    run = np.searchsorted(first, np.arange(len(table)), "right") - 1
    return np.sort(order[np.isin(first[run], kept)])


def _values(table: pd.DataFrame, metrics: list[str]) -> np.ndarray:
    # NaN is larger than all numbers, as in Spark's own comparisons
    return np.nan_to_num(table[metrics].to_numpy(np.float64), nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _groups(table: pd.DataFrame, keys: list[str]) -> np.ndarray:
    return table.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()


def _fronts(keys: list[str], metrics: list[str], sorted_runs: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fronts of chunks; with ``sorted_runs`` a run of equal keys is never cut."""
    held: list[pa.RecordBatch] = []

    def reduced(table: pa.Table) -> Iterator[pa.RecordBatch]:
        frame = table.to_pandas()
        if len(frame):
            yield from table.take(pa.array(front(_values(frame, metrics), _groups(frame, keys)))).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        if sorted_runs:
            group = _groups(table.to_pandas(), keys)
            end = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            yield from reduced(table.slice(0, end))
            held = table.slice(end).to_batches()
        else:
            yield from reduced(table)
            held = []
    if held:
        yield from reduced(pa.Table.from_batches(held))


def _between(metrics: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a later block that rows of an earlier one dominate; both sides of a pair of blocks come together, sorted."""
    held: list[pa.Table] = []

    def found() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        frame = table.to_pandas()
        later = frame["side"].to_numpy() == 1
        values = _values(frame, metrics)
        hit = np.flatnonzero(later)[dominated(values[~later][:, 1:], values[later][:, 1:])]
        yield from table.take(pa.array(hit)).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        pair = table["pair"].to_numpy()
        for part in np.split(np.arange(len(pair)), np.flatnonzero(pair[1:] != pair[:-1]) + 1):
            if not len(part):
                continue
            if held and held[-1]["pair"][0].as_py() != pair[part[0]]:
                yield from found()
                held = []
            held.append(table.slice(part[0], len(part)))
    if held:
        yield from found()


def _without_weak(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows that none of the strongest rows of their group dominates."""
    strength = reduce(lambda a, b: a + b, [F.col(m) for m in metrics])
    strong = top_k(rows, keys, [strength.desc(), *[F.col(m).desc() for m in metrics]], STRONGEST, "__rank")
    held = strong.groupBy(*keys).agg(F.collect_list(F.struct(*metrics)).alias("__strong"))
    held = broadcast_if_small(held)
    joined = null_safe_join(rows, held, keys, "left")

    def beats(s):
        as_good = reduce(lambda a, b: a & b, [s[m] >= F.col(m) for m in metrics])
        return as_good & reduce(lambda a, b: a | b, [s[m] > F.col(m) for m in metrics])

    return joined.filter(~F.exists("__strong", beats)).drop("__strong")


def skyline(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct (keys, metrics) that no other row of the group is as good as on all metrics and better on one.

    Null keys are groups; rows with a null metric neither dominate nor appear. Metrics are compared as doubles.
    """
    if not keys:
        return skyline(rows.withColumn("__all", F.lit(0)), metrics, ["__all"], task_rows).drop("__all")
    keys, metrics = list(keys), list(metrics)
    columns = [*keys, *metrics]
    vectors = rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).dropna(subset=metrics).distinct()
    left = cut(vectors.mapInArrow(lambda it: _fronts(keys, metrics, False, it), vectors.schema))
    left = cut(_without_weak(left, keys, metrics))
    done = []
    size = None
    while True:
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        sized = null_safe_join(left, sizes, keys)
        buckets = F.ceil(F.col("__n") / task_rows).cast("int")
        sized = sized.withColumn("__bucket", F.when(buckets > 1, F.pmod(F.xxhash64(*metrics), buckets)).otherwise(0)).withColumn("__whole", F.col("__n") <= task_rows).drop("__n")
        group = [*keys, "__bucket"]
        dealt = sized.repartition(*group, "__whole").sortWithinPartitions(*group)
        merged = cut(dealt.mapInArrow(lambda it: _fronts(group, metrics, True, it), dealt.schema))
        done.append(merged.filter("__whole").select(*columns))
        left = cut(merged.filter("NOT __whole").select(*columns))
        before, size = size, left.count()
        if not size:
            break
        if before is not None and size > 0.8 * before:
            done.append(_last_check(left, keys, metrics, task_rows))
            break
    return reduce(DataFrame.unionByName, done)


def _last_check(left: DataFrame, keys: list[str], metrics: list[str], task_rows: int) -> DataFrame:
    """Fronts of groups that exceed a task: blocks along the order, compared where their extremes allow dominance."""
    order = [F.col(m).desc() for m in metrics]
    placed = running_totals(left, keys, order, {"__place": F.lit(1)})
    placed = placed.withColumn("__block", F.floor((F.col("__place") - 1) / task_rows).cast("int")).drop("__place")
    dealt = placed.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block")
    blocks = cut(dealt.mapInArrow(lambda it: _fronts([*keys, "__block"], metrics, True, it), dealt.schema))
    extremes = cut(blocks.groupBy(*keys, "__block").agg(*[F.max(m).alias(f"__max_{m}") for m in metrics], *[F.min(m).alias(f"__min_{m}") for m in metrics]))
    later = extremes.select(*keys, F.col("__block").alias("__later"), *[F.col(f"__min_{m}").alias(f"__least_{m}") for m in metrics])
    pairs = null_safe_join(extremes, later, keys)
    possible = reduce(lambda a, b: a & b, [F.col(f"__max_{m}") >= F.col(f"__least_{m}") for m in metrics])
    pairs = pairs.filter((F.col("__block") < F.col("__later")) & possible).select(*keys, "__block", "__later")
    pairs = cut(pairs.withColumn("pair", F.monotonically_increasing_id()))
    ends = [pairs.select(*keys, F.col(c).alias("__block"), "pair", F.lit(side).alias("side")) for side, c in enumerate(("__block", "__later"))]
    met = null_safe_join(blocks, ends[0].union(ends[1]), [*keys, "__block"])
    met = met.repartition("pair").sortWithinPartitions("pair", "side")
    beaten = met.mapInArrow(lambda it: _between(metrics, it), met.schema).select(*keys, *metrics).distinct()
    return null_safe_join(blocks.select(*keys, *metrics), beaten, [*keys, *metrics], "left_anti")
