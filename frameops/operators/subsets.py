"""Precision summed over ranked rows for overlapping subsets of them, without a copy of a row per subset.

A row carries the subsets it is in as bits of one number. Ranges of the order are counted per model and subset first, which needs
no order inside them; their running totals give each range its start, and one shuffle brings each range to a task that walks it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.lineage import stored
from frameops.operators.ranges import borders_of, collected, dealt, place, tables, whole_images_only

#: Subsets at most, one bit each, and starts at most (two numbers per range, model and subset).
MOST_SUBSETS, MOST_STARTS = 62, 2_000_000


def subset_bits(names: Sequence[str], column: str = "subgroup"):
    """The bit of a subset's name."""
    chosen = F
    for i, name in enumerate(names):
        chosen = chosen.when(F.col(column).eqNullSafe(F.lit(name)), F.lit(1 << i).cast("long"))
    return chosen.otherwise(F.lit(0).cast("long"))


def _placed(borders: np.ndarray, numbers: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Model, mask and hit of rows with the number of their range."""
    for batch in batches:
        part = place(borders, numbers, batch)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch["m"], batch["mask"], batch["hit"]], names=["part", "m", "mask", "hit"])


def _walk(starts, models: int, subsets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Precision at the true positives of each range, summed per model and subset; rows come in order within their range."""
    for at, table in tables(batches):
        state, total = starts.value[at].copy(), np.zeros((models, subsets))
        model, mask, hit = (table[c].to_numpy().astype(np.int64) for c in ("m", "mask", "hit"))
        for m in range(models):
            own = np.flatnonzero(model == m)
            for s in range(subsets):
                inside = hit[own[(mask[own] >> s) & 1 == 1]]
                seen, hits = state[0, m, s] + np.arange(1, len(inside) + 1), state[1, m, s] + np.cumsum(inside)
                total[m, s] += (hits / seen)[inside == 1].sum()
        m, s = np.indices((models, subsets)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), at, np.int32)), pa.array(m), pa.array(s), pa.array(total.ravel())], names=["part", "m", "s", "precision_sum"])


def subset_precision(rows: DataFrame, models: Sequence, names: Sequence[str], model: str) -> tuple[DataFrame, DataFrame]:
    """Per (model, subgroup): precision_sum, true_positives and false_positives, and the stored rows with ``m`` and ``mask``.

    ``rows`` has image_id, pred_id, score, true_positive, the model column and mask, the subsets of its image (``subset_bits``).
    Ranks are by score, then image_id, then pred_id. Rows are stored once, since three passes read them.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[model]
    number = F
    for i, name in enumerate(models):
        number = number.when(F.col(model).eqNullSafe(F.lit(name)), F.lit(i))
    rows = rows.select("image_id", "pred_id", "score", F.col("true_positive").cast("int").alias("hit"), number.otherwise(F.lit(-1)).alias("m"), "mask")
    ranked = stored(rows.filter("m >= 0"), "ranked")
    borders, numbers = borders_of(ranked, MOST_STARTS // (len(models) * len(names))), whole_images_only(ranked)
    placed = ranked.select("score", "image_id", "m", "mask", "hit").mapInArrow(lambda it: _placed(borders, numbers, it), "part int, m int, mask long, hit int")
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.col("mask"), i)) == 1)
    grouped = placed.groupBy("part", "m", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    counted = grouped.select("part", "m", F.explode(bits).alias("s"), "n", "h").groupBy("part", "m", "s").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    # a number per range, model and subset
    counts = np.zeros((len(borders) + 2, 2, len(models), len(names)), np.int64)
    for r in collected(counted):
        counts[r["part"] + 1, :, r["m"], r["s"]] = r["n"], r["h"]
    running = counts.cumsum(0)
    starts = spark.sparkContext.broadcast({part: running[part] for part in range(len(borders) + 1)})
    sums = dealt(ranked, borders).mapInArrow(lambda it: _walk(starts, len(models), len(names), it), "part int, m int, s int, precision_sum double")
    precision = np.zeros((len(models), len(names)))
    for r in sorted(collected(sums), key=lambda r: r["part"]):
        precision[r["m"], r["s"]] += r["precision_sum"]
    seen, hits = running[-1]
    table = [(models[m], names[s], float(precision[m, s]), int(hits[m, s]), int(seen[m, s] - hits[m, s])) for m in range(len(models)) for s in range(len(names)) if seen[m, s]]
    schema = f"`{model}` {kind}, subgroup string, precision_sum double, true_positives long, false_positives long"
    return spark.createDataFrame(table, schema), ranked
