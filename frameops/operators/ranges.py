"""Stored rows dealt to ranges of their rank (score falling, image_id and pred_id rising), in blocks of arrays.

A map task turns its rows of one range into a few rows of arrays, sorted by rank, so that a shuffle of many narrow rows costs a
few bytes each. A range meets in one task as one table in order; there are more ranges where there are more rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.lineage import shuffles_removed

#: Rows of the sample that places the borders of ranges, rows of a range, and rows of a map task that are packed together.
SAMPLE, RANGE_ROWS, PACK_ROWS = 20_000, 1_000_000, 200_000
KEY = ("score", "image_id", "pred_id")
_BORDER = [("score", np.float64), ("image", np.int64)]


def whole_images_only(rows: DataFrame) -> bool:
    """Whether images are numbers, which then cut ranges between equal scores; other ids leave equal scores in one range."""
    return dict(rows.dtypes)["image_id"] in ("int", "bigint")


def borders_of(rows: DataFrame, most: int | None = None) -> np.ndarray:
    """Ends of the ranges of ``rows`` (stored): as many as shuffle partitions, or one per ``RANGE_ROWS``, but at most ``most``."""
    n = rows.count()
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranges = max(1, min(ranges, most or ranges))
    image = F.col("image_id").cast("long") if whole_images_only(rows) else F.lit(0).cast("long")
    step = max(1, n // max(SAMPLE, 20 * ranges))
    sample = rows.filter(F.pmod(F.xxhash64("image_id", "pred_id"), F.lit(step)) == 0).filter("score IS NOT NULL AND NOT isnan(score)").select(F.col("score").cast("double").alias("score"), image.alias("image"))
    found = sorted({(-r["score"], r["image"]) for r in sample.filter("image IS NOT NULL").collect()})
    picked = [found[len(found) * i // ranges] for i in range(1, ranges)] if len(found) >= ranges else found
    return np.array([(-s, i) for s, i in picked[: ranges - 1]], dtype=_BORDER)


def place(borders: np.ndarray, numbers: bool, rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The range of each row."""
    n, score = rows.num_rows, rows["score"]
    image = pc.fill_null(rows["image_id"], np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) if numbers else np.zeros(n, np.int64)
    order = np.lexsort((np.concatenate([np.zeros(len(borders)), np.ones(n)]), np.concatenate([borders["image"], image]),
                        np.concatenate([-borders["score"], -score.to_numpy(zero_copy_only=False).astype(np.float64)])))
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(order < len(borders))
    part = part[len(borders):]
    # NaN ranks before all numbers, null behind them
    part[pc.fill_null(pc.is_nan(score), False).to_numpy(zero_copy_only=False)] = 0
    part[pc.is_null(score).to_numpy(zero_copy_only=False)] = len(borders)
    return part


def by_rank(table: pa.Table) -> pa.Table:
    """Rows by score, NaN first and null last, then image_id and pred_id."""
    table = table.combine_chunks()
    score = table["score"].combine_chunks()
    kind = np.where(pc.is_null(score).to_numpy(zero_copy_only=False), 2, 1)
    kind[pc.fill_null(pc.is_nan(score), False).to_numpy(zero_copy_only=False)] = 0
    down = np.where(kind == 1, -score.to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
    ids = [table[c].combine_chunks() for c in KEY[1:]]
    if all(pa.types.is_integer(c.type) and not c.null_count for c in ids):
        order = np.lexsort((ids[1].to_numpy(), ids[0].to_numpy(), down, kind))
    else:
        keys = pa.table([pa.array(kind), pa.array(down), *ids], names=["kind", "down", "image_id", "pred_id"])
        order = pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start").to_numpy()
    return table.take(pa.array(order))


def _packed(borders: np.ndarray, numbers: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0

    def pack() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        part = place(borders, numbers, table)
        table = by_rank(table.append_column("part", pa.array(part.astype(np.int32))))
        # a range is a run of ranks
        part = table["part"].combine_chunks().to_numpy()
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        ends = pa.array(np.append(begin, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, table[c].combine_chunks()) for c in table.column_names if c != "part"]
        return pa.RecordBatch.from_arrays([pa.array(part[begin]), *lists], names=["part", *[c for c in table.column_names if c != "part"]])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= PACK_ROWS:
            yield pack()
            held, count = [], 0
    if held:
        yield pack()


def dealt(rows: DataFrame, borders: np.ndarray) -> DataFrame:
    """Blocks of ``rows`` (part and an array per column), those of a range together and ranges in order within a task."""
    numbers = whole_images_only(rows)
    schema = "part int, " + ", ".join(f"{name} array<{kind}>" for name, kind in rows.dtypes)
    blocks = rows.mapInArrow(lambda it: _packed(borders, numbers, it), schema)
    return blocks.repartition(len(borders) + 1, "part").sortWithinPartitions("part")


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each range of a task with its rows in order."""
    at, held = None, []
    for batch in batches:
        parts = batch["part"].to_numpy()
        for i in range(batch.num_rows):
            if parts[i] != at:
                if held:
                    yield at, by_rank(pa.concat_tables(held))
                at, held = int(parts[i]), []
            one = batch.slice(i, 1)
            held.append(pa.table([one[c].flatten() for c in batch.schema.names if c != "part"], names=[c for c in batch.schema.names if c != "part"]))
    if held:
        yield at, by_rank(pa.concat_tables(held))


def collected(df: DataFrame) -> list:
    """Rows of a small result; its shuffles are removed."""
    with shuffles_removed(df.sparkSession):
        return df.collect()
