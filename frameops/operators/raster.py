"""Pixel operators (R01-R08) on row strips.  A pixel is a row (image_id, row, col, v).

Pixels are shuffled once, to strips of ``STRIP`` image rows with as many rows of their neighbours as the operator looks at, and
each strip becomes one dense array. Means over windows come from summed-area tables, boxes are painted into the array, and image
measures are partial sums per strip. A frame of any size is spread over its strips; no window runs along a line of pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col
#: Image rows of a strip.
STRIP = 64


class Strip(NamedTuple):
    """Rows of a strip and its surroundings: pixels (NaN where there is none) of one or two planes, boxes by id, own rows."""

    top: int
    left: int
    planes: list[np.ndarray]
    boxes: np.ndarray
    own: slice

    def owner(self) -> np.ndarray:
        """Place of the lowest box that covers each pixel, -1 outside; far borders are exclusive."""
        out = np.full(self.planes[0].shape, -1)
        for i in range(len(self.boxes) - 1, -1, -1):
            x1, y1, x2, y2 = self.boxes[i]
            out[max(0, y1 - self.top) : max(0, y2 - self.top), max(0, x1 - self.left) : max(0, x2 - self.left)] = i
        return out


def _sums(values: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the square of ``reach`` around each pixel, cut at the borders, from a summed-area table."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    table[1:, 1:] = values.cumsum(0).cumsum(1)
    low, high = ([np.clip(np.arange(n) + d, 0, n) for n in values.shape] for d in (-reach, reach + 1))
    return table[high[0]][:, high[1]] - table[low[0]][:, high[1]] - table[high[0]][:, low[1]] + table[low[0]][:, low[1]]


def _read(table: pa.Table, halo: int) -> Strip | None:
    plane, row, col, v = (table[c].to_numpy() for c in ("plane", "row", "col", "v"))
    pixel = plane >= 0
    if not pixel.any():
        return None
    boxes = np.stack([table[c].to_numpy(zero_copy_only=False)[~pixel] for c in ("row", "col", "y2", "x2")], 1).astype(np.int64)[:, [1, 0, 3, 2]]
    order = np.argsort(table["box_id"].to_numpy(zero_copy_only=False)[~pixel], kind="stable")
    plane, row, col, v = plane[pixel], row[pixel], col[pixel], v[pixel]
    top, left = int(row.min()), int(col.min())
    planes = []
    for p in range(int(plane.max()) + 1):
        dense = np.full((int(row.max()) - top + 1, int(col.max()) - left + 1), np.nan)
        at = plane == p
        dense[row[at] - top, col[at] - left] = v[at]
        planes.append(dense)
    first = int(table["strip"][0].as_py()) * STRIP
    return Strip(top, left, planes, boxes[order], slice(max(0, first - top), max(0, first + STRIP - top)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one strip of one image at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        number = table["number"].to_numpy()
        for part in np.split(np.arange(len(number)), np.flatnonzero(number[1:] != number[:-1]) + 1):
            piece = table.slice(part[0], len(part))
            if held and (held[-1]["number"][0] != piece["number"][0] or held[-1]["strip"][0] != piece["strip"][0] or held[-1]["image_id"][0] != piece["image_id"][0]):
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)


def _on_strips(planes: Sequence[DataFrame], boxes: DataFrame | None, halo: int, schema: str, work: Callable[[Strip], dict[str, np.ndarray]]) -> DataFrame:
    """What ``work`` makes of each strip, as rows with image_id."""

    def near(low, high):
        return F.explode(F.sequence(F.floor((low - halo) / STRIP), F.floor((high + halo) / STRIP)))

    none = F.lit(None).cast("long")
    rows = None
    for i, px in enumerate(planes):
        part = px.select("image_id", F.lit(i).alias("plane"), C("row").cast("long").alias("row"), C("col").cast("long").alias("col"), C("v").cast("double").alias("v"),
                         none.alias("y2"), none.alias("x2"), none.alias("box_id")).withColumn("strip", near(C("row"), C("row")))
        rows = part if rows is None else rows.unionByName(part)
    if boxes is not None:
        kept = boxes.filter((C("x2") > C("x1")) & (C("y2") > C("y1")))
        part = kept.select("image_id", F.lit(-1).alias("plane"), C("y1").cast("long").alias("row"), C("x1").cast("long").alias("col"), F.lit(0.0).alias("v"),
                           C("y2").cast("long").alias("y2"), C("x2").cast("long").alias("x2"), C("box_id").cast("long").alias("box_id"))
        rows = rows.unionByName(part.withColumn("strip", near(C("row"), C("y2") - 1)))
    rows = rows.withColumn("number", F.xxhash64("image_id", "strip")).repartition("image_id", "strip").sortWithinPartitions("number", "image_id", "strip")
    image = planes[0].schema["image_id"]
    out = T.StructType([image, *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            strip = _read(table, halo)
            made = work(strip) if strip is not None else None
            if made is None:
                continue
            n = len(next(iter(made.values())))
            for low in range(0, n, 100_000):
                part = {k: v[low : low + 100_000] for k, v in made.items()}
                ids = pa.array([table["image_id"][0].as_py()], table["image_id"].type).take(pa.array(np.zeros(len(next(iter(part.values()))), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v) for v in part.values()]], names=["image_id", *part])

    return rows.mapInArrow(run, out)


def _pixels(strip: Strip, values: np.ndarray) -> dict[str, np.ndarray]:
    own = np.zeros(values.shape, bool)
    own[strip.own] = ~np.isnan(strip.planes[0][strip.own])
    row, col = np.nonzero(own)
    return {"row": row + strip.top, "col": col + strip.left, "v": values[own]}


_PIXEL = "row long, col long, v double"


def _whole(px: DataFrame, out: DataFrame) -> DataFrame:
    """Result pixels in the column types of ``px``."""
    return out.select("image_id", *[C(c).cast(px.schema[c].dataType).alias(c) for c in ("row", "col", "v")])


def raster_quality(px: DataFrame, dark: int = 40, bright: int = 215) -> DataFrame:
    """Brightness, contrast, Laplacian variance and dark and bright share (edges mirrored)."""

    def work(strip: Strip) -> dict[str, np.ndarray]:
        v = strip.planes[0]
        wide = np.pad(v, 1, constant_values=np.nan)
        sides = []
        for before, after in ((wide[1:-1, :-2], wide[1:-1, 2:]), (wide[:-2, 1:-1], wide[2:, 1:-1])):
            sides.append(np.where(np.isnan(before), after, before) + np.where(np.isnan(after), before, after))
        lap, own = (sides[0] + sides[1] - 4 * v)[strip.own], v[strip.own]
        held, edged = own[~np.isnan(own)], lap[~np.isnan(lap)]
        sums = (held.size, held.sum(), (held * held).sum(), edged.size, edged.sum(), (edged * edged).sum(), (held < dark).sum(), (held > bright).sum())
        return {name: np.array([x], float) for name, x in zip(names, sums)}

    names = ("n", "s", "ss", "ln", "ls", "lss", "dark", "bright")
    parts = _on_strips([px], None, 1, ", ".join(f"{n} double" for n in names), work)
    total = parts.groupBy("image_id").agg(*[F.sum(n).alias(n) for n in names])

    def spread(n, s, ss):
        return F.when(C(n) > 0, F.greatest(F.lit(0.0), (C(ss) - C(s) * C(s) / C(n)) / C(n)))

    return total.select(
        "image_id", (C("s") / C("n")).alias("brightness"), F.sqrt(spread("n", "s", "ss")).alias("contrast"), spread("ln", "ls", "lss").alias("laplacian_variance"),
        (C("dark") / C("n")).alias("dark_share"), (C("bright") / C("n")).alias("bright_share"))


def raster_blockiness(px: DataFrame, block: int = 8) -> DataFrame:
    """Block boundary minus interior steps on both axes, at least 0; and the simple boundary mean."""

    def work(strip: Strip) -> dict[str, np.ndarray]:
        v = strip.planes[0]
        across = np.abs(v[strip.own, 1:] - v[strip.own, :-1])
        down = np.full(v.shape, np.nan)
        down[1:] = np.abs(v[1:] - v[:-1])
        down = down[strip.own]
        out = {"axis": [], "i": [], "s": [], "n": []}
        for axis, steps, first in ((0, across.T, strip.left + 1), (1, down, strip.top + strip.own.start)):
            held = ~np.isnan(steps)
            at = np.flatnonzero(held.any(1))
            out["axis"].append(np.full(len(at), axis))
            out["i"].append(at + first)
            out["s"].append(np.nansum(steps[at], 1))
            out["n"].append(held[at].sum(1))
        return {k: np.concatenate(x).astype(np.float64 if k == "s" else np.int64) for k, x in out.items()}

    steps = _on_strips([px], None, 1, "axis long, i long, s double, n long", work)
    steps = steps.groupBy("image_id", "axis", "i").agg((F.sum("s") / F.sum("n")).alias("d"))
    at = C("i") % block
    # an interior offset listed twice (block of two or three) counts twice
    inner = F.when(at == 1, 1).otherwise(0) + F.when(at == max(1, block // 2), 1).otherwise(0)
    per = steps.groupBy("image_id", "axis").agg(
        F.coalesce(F.avg(F.when(at == 0, C("d"))), F.lit(0.0)).alias("boundary"), F.coalesce(F.sum(F.when(at == 0, C("d"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.try_divide(F.sum(inner * C("d")), F.sum(inner)), F.lit(0.0)).alias("inside"), (F.max("i") + 1).alias("size"))
    out = per.groupBy("image_id").agg(F.sum(C("boundary") - C("inside")).alias("score"), F.sum("total").alias("total"), F.sum(F.floor(C("size") / block)).alias("blocks"))
    return out.select("image_id", F.greatest(F.lit(0.0), C("score")).alias("blockiness"), (C("total") / F.greatest(C("blocks"), F.lit(1))).alias("boundary_mean"))


def raster_pixelate(px: DataFrame, boxes: DataFrame, block: int) -> DataFrame:
    """Block means inside boxes, blocks counted from the box corner."""

    def work(strip: Strip) -> dict[str, np.ndarray]:
        v, owner = strip.planes[0], strip.owner()
        row, col = np.nonzero((owner >= 0) & ~np.isnan(v))
        out = v.copy()
        if len(row):
            box = owner[row, col]
            tile = np.stack([box, (row + strip.top - strip.boxes[box, 1]) // block, (col + strip.left - strip.boxes[box, 0]) // block], 1)
            _, at = np.unique(tile, axis=0, return_inverse=True)
            at = at.ravel()
            out[row, col] = np.floor(np.bincount(at, v[row, col]) / np.bincount(at))[at]
        return _pixels(strip, out)

    return _whole(px, _on_strips([px], boxes, block - 1, _PIXEL, work))


def raster_fill(px: DataFrame, boxes: DataFrame, value: int = 0) -> DataFrame:
    """Constant inside boxes."""

    def work(strip: Strip) -> dict[str, np.ndarray]:
        return _pixels(strip, np.where(strip.owner() >= 0, float(value), strip.planes[0]))

    return _whole(px, _on_strips([px], boxes, 0, _PIXEL, work)).withColumn("v", C("v").cast("bigint"))


def raster_blur(px: DataFrame, boxes: DataFrame, radius: int) -> DataFrame:
    """Box mean (not Gaussian) inside boxes, over the pixels there are."""

    def work(strip: Strip) -> dict[str, np.ndarray]:
        v = strip.planes[0]
        held = ~np.isnan(v)
        mean = _sums(np.where(held, v, 0.0), radius) / np.maximum(_sums(held.astype(float), radius), 1)
        return _pixels(strip, np.where(strip.owner() >= 0, mean, v))

    return _on_strips([px], boxes, radius, _PIXEL, work).select("image_id", *[C(c).cast(px.schema[c].dataType).alias(c) for c in ("row", "col")], "v")


def background_preservation(before: DataFrame, after: DataFrame, boxes: DataFrame) -> DataFrame:
    """One minus the mean absolute change outside all boxes over 255; null when boxes cover the image."""

    def work(strip: Strip) -> dict[str, np.ndarray] | None:
        if len(strip.planes) < 2:
            return None
        change = np.abs(strip.planes[0] - strip.planes[1])[strip.own]
        outside = change[(strip.owner()[strip.own] < 0) & ~np.isnan(change)]
        return {"s": np.array([outside.sum()]), "n": np.array([outside.size])}

    parts = _on_strips([before, after], boxes, 0, "s double, n long", work)
    kept = parts.groupBy("image_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - C("s") / C("n") / 255.0))
    return kept.select("image_id", F.when(C("n") > 0, clipped).alias("background_preservation"))


def area_aware_operator(boxes: DataFrame, fill_up_to: float = 0.22) -> DataFrame:
    """Fill small boxes, blur large ones.  Needs width and height."""
    x1, y1 = F.greatest(F.lit(0), C("x1")), F.greatest(F.lit(0), C("y1"))
    x2, y2 = F.least(C("width"), C("x2")), F.least(C("height"), C("y2"))
    share = (x2 - x1) * (y2 - y1) / (C("width") * C("height"))
    kept = boxes.filter((x2 > x1) & (y2 > y1))
    return kept.withColumn("operator", F.when(share <= fill_up_to, "fill").otherwise("blur"))


def redact_regions(px: DataFrame, boxes: DataFrame, modes: Sequence[str] = ("fill", "blur", "pixelate"), radius: int = 1, block: int = 2) -> DataFrame:
    """Text and screen regions redacted by their own mode (column ``operator``), one pass per mode."""
    out = px.withColumn("v", C("v").cast("double"))
    for mode in modes:
        part = boxes.filter(C("operator") == mode)
        if mode == "fill":
            out = raster_fill(out, part).withColumn("v", C("v").cast("double"))
        elif mode == "blur":
            out = raster_blur(out, part, radius)
        elif mode == "pixelate":
            out = raster_pixelate(out, part, block).withColumn("v", C("v").cast("double"))
        else:
            raise ValueError(f"unknown mode {mode}")
    return out
