"""Greedy box passes on images with more boxes than one fold takes.

Boxes of an image are numbered in visiting order and handled in batches of bounded size, one round per batch: a task runs the
greedy pass over the batch of its image, and what the batch decides is applied to the boxes behind it. Rounds are as many as the
largest image has batches, whatever the boxes look like: a stack of copies, a long chain, or both.

Boxes that overlap by the threshold t have sides within a factor of t, so they are looked up in cells that follow their size: the
kept boxes of one cell overlap each other less than t, hence are few, and a stack never turns into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.geometry import CORNERS, has_area, iou
from frameops.lineage import cut
from frameops.operators.rounds import count_tiles
from frameops.operators.scale import null_safe_join, running_totals

#: Boxes of one image and round.
BATCH = 100_000
#: Side of a cell of the truth boxes in a task, in pixels, and taken boxes after which its index is built anew.
CELL, REBUILD = 256, 2000


def _base(threshold: float) -> float:
    """Factor between two size classes, a little wide, so that rounding parts no pair."""
    return 1.01 / threshold


class Kept:
    """Kept boxes of a task by size class and place."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.base = threshold, _base(threshold)
        self.cells: dict[tuple, list[int]] = {}
        self.boxes: list[tuple] = []

    def _level(self, side: float) -> int:
        return math.floor(math.log(side) / math.log(self.base))

    def _span(self, middle: float, side: float, level: int) -> range:
        width = self.base ** (level + 1)
        reach = (side + width) / 2
        return range(math.floor((middle - reach) / width), math.floor((middle + reach) / width) + 1)

    def first_over(self, box: tuple) -> int | None:
        """The earliest kept box that overlaps ``box`` by the threshold."""
        x1, y1, x2, y2 = box
        w, h = x2 - x1, y2 - y1
        if w <= 0 or h <= 0:
            return None
        best = None
        lx, ly = self._level(w), self._level(h)
        for a in (lx - 1, lx, lx + 1):
            xs = self._span((x1 + x2) / 2, w, a)
            for b in (ly - 1, ly, ly + 1):
                for i in xs:
                    for j in self._span((y1 + y2) / 2, h, b):
                        for k in self.cells.get((a, b, i, j), ()):
                            if best is not None and k >= best:
                                break
                            p1, q1, p2, q2 = self.boxes[k]
                            inter = max(0, min(x2, p2) - max(x1, p1)) * max(0, min(y2, q2) - max(y1, q1))
                            if inter > 0 and inter / (w * h + (p2 - p1) * (q2 - q1) - inter) >= self.threshold:
                                best = k
                                break
        return best

    def add(self, box: tuple) -> None:
        x1, y1, x2, y2 = box
        self.boxes.append(box)
        w, h = x2 - x1, y2 - y1
        if w > 0 and h > 0:
            a, b = self._level(w), self._level(h)
            cell = (a, b, math.floor((x1 + x2) / 2 / self.base ** (a + 1)), math.floor((y1 + y2) / 2 / self.base ** (b + 1)))
            self.cells.setdefault(cell, []).append(len(self.boxes) - 1)


def seeds_in_order(rows: pd.DataFrame, threshold: float) -> np.ndarray:
    """Place of the kept box that captures each row, its own when it is kept; rows come in visiting order."""
    kept, places, out = Kept(threshold), [], np.arange(len(rows))
    for i, (*box, always) in enumerate(zip(*(rows[c].tolist() for c in CORNERS), rows["always"].tolist())):
        hit = None if always else kept.first_over(tuple(box))
        if hit is None:
            kept.add(tuple(box))
            places.append(i)
        else:
            out[i] = places[hit]
    return out


def _cell_columns(threshold: float) -> dict[str, Column]:
    """Size class and cell of a box, as in ``Kept.add``."""
    base = _base(threshold)
    level = {d: F.floor(F.log(F.col(f"{d}2") - F.col(f"{d}1")) / math.log(base)) for d in ("x", "y")}
    place = {d: F.floor((F.col(f"{d}1") + F.col(f"{d}2")) / 2 / F.pow(F.lit(base), level[d] + 1)) for d in ("x", "y")}
    return {"__lx": level["x"], "__ly": level["y"], "__cx": place["x"], "__cy": place["y"]}


def _reached_cells(kept: DataFrame, threshold: float) -> DataFrame:
    """A row per cell in which a box that the kept one captures may lie."""
    base = _base(threshold)
    for d in ("x", "y"):
        low, high = F.col(f"l_{d}1"), F.col(f"l_{d}2")
        level = F.floor(F.log(high - low) / math.log(base))
        kept = kept.withColumn(f"__l{d}", F.explode(F.sequence(level - 1, level + 1)))
        width = F.pow(F.lit(base), F.col(f"__l{d}") + 1)
        reach, middle = (high - low + width) / 2, (low + high) / 2
        kept = kept.withColumn(f"__c{d}", F.explode(F.sequence(F.floor((middle - reach) / width), F.floor((middle + reach) / width))))
    return kept


def suppress_in_batches(boxes: DataFrame, threshold: float, order: Sequence[Column], box_id: str, extra: Sequence[str],
                        fixed: Column | None, batch: int = BATCH) -> DataFrame:
    """``suppress`` for crowded images: input columns plus ``seed``."""
    keys = ["image_id", *extra]
    always = fixed if fixed is not None else F.lit(False)
    side = boxes.select(*keys, F.col(box_id).alias("id"), *[o.alias(f"__k{i}") for i, o in enumerate(order)], always.alias("always"), *CORNERS)
    ranked = running_totals(side, keys, [*[F.col(f"__k{i}") for i in range(len(order))], F.col("id")], {"place": F.lit(1)})
    waiting = cut(ranked.select(*keys, "id", "place", "always", *CORNERS, F.floor((F.col("place") - 1) / batch).alias("batch")))
    decided = []
    while (now := waiting.agg(F.min("batch")).first()[0]) is not None:
        first = waiting.filter(F.col("batch") == now)
        schema = first.select(*keys, "id", "place", *CORNERS, F.col("id").alias("seed")).schema

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place", ignore_index=True)
            rows["seed"] = rows["id"].to_numpy()[seeds_in_order(rows, threshold)]
            return rows[schema.names]

        done = cut(first.groupBy(*keys).applyInPandas(run, schema))
        decided.append(done.select(*keys, "id", "seed"))
        rest = waiting.filter(F.col("batch") > now)
        kept = done.filter(F.col("id") == F.col("seed")).select(*keys, F.col("id").alias("l_id"), F.col("place").alias("l_place"), *[F.col(c).alias(f"l_{c}") for c in CORNERS])
        probes = _reached_cells(kept.filter(has_area("l_")), threshold)
        open_boxes = rest.filter(~F.col("always") & has_area()).select(*keys, "id", *[F.col(c).alias(f"r_{c}") for c in CORNERS], *[v.alias(n) for n, v in _cell_columns(threshold).items()])
        met = null_safe_join(open_boxes, probes, [*keys, "__lx", "__ly", "__cx", "__cy"]).filter(iou("l_", "r_") >= threshold)
        hit = cut(met.groupBy(*keys, "id").agg(F.min(F.struct("l_place", "l_id")).alias("f")).select(*keys, "id", F.col("f.l_id").alias("seed")))
        decided.append(hit)
        waiting = cut(null_safe_join(rest, hit.select(*keys, "id"), [*keys, "id"], "left_anti"))
    seeds = reduce(DataFrame.unionByName, decided) if decided else waiting.select(*keys, "id", F.col("id").alias("seed"))
    return null_safe_join(boxes.withColumn("id", F.col(box_id)), seeds, [*keys, "id"]).select(*boxes.columns, "seed")


class Free:
    """Free truth boxes of a task, in id order, by cell."""

    def __init__(self, corners: np.ndarray) -> None:
        self.corners, self.free = corners, np.ones(len(corners), bool)
        self.area = (corners[:, 2] - corners[:, 0]) * (corners[:, 3] - corners[:, 1])
        self.build()

    def build(self) -> None:
        self.taken = 0
        cells: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(self.free & (self.corners[:, 2] > self.corners[:, 0]) & (self.corners[:, 3] > self.corners[:, 1])):
            x1, y1, x2, y2 = self.corners[i]
            for cx in range(int(x1 // CELL), int(x2 // CELL) + 1):
                for cy in range(int(y1 // CELL), int(y2 // CELL) + 1):
                    cells.setdefault((cx, cy), []).append(i)
        self.cells = {c: np.array(v) for c, v in cells.items()}

    def best(self, box: tuple) -> tuple[int, float]:
        """The free box of highest IoU, the first on ties; -1 when none overlaps."""
        x1, y1, x2, y2 = box
        if x2 <= x1 or y2 <= y1:
            return -1, 0.0
        found, value = -1, 0.0
        for cx in range(int(x1 // CELL), int(x2 // CELL) + 1):
            for cy in range(int(y1 // CELL), int(y2 // CELL) + 1):
                held = self.cells.get((cx, cy))
                if held is None:
                    continue
                c = self.corners[held]
                inter = np.maximum(0, np.minimum(x2, c[:, 2]) - np.maximum(x1, c[:, 0])) * np.maximum(0, np.minimum(y2, c[:, 3]) - np.maximum(y1, c[:, 1]))
                share = np.where(self.free[held], inter / ((x2 - x1) * (y2 - y1) + self.area[held] - inter), 0.0)
                top = int(share.argmax())
                if share[top] > value or (share[top] == value > 0 and held[top] < found):
                    found, value = int(held[top]), float(share[top])
        return found, value

    def take(self, i: int) -> None:
        self.free[i] = False
        self.taken += 1
        if self.taken >= REBUILD:
            self.build()


def assign_in_batches(seekers: DataFrame, targets: DataFrame, threshold: float, order: Sequence[Column], seeker_id: str, target_id: str,
                      extra: Sequence[str], batch: int = BATCH) -> DataFrame:
    """``assign`` for crowded images: seeker columns plus ``target`` and ``best_iou``.

    A batch meets the truth boxes of its image that are still free. The truth of one image is taken to fit a task.
    """
    keys = ["image_id", *extra]
    side = seekers.select(*keys, F.col(seeker_id).alias("id"), *[o.alias(f"__k{i}") for i, o in enumerate(order)], *CORNERS)
    ranked = running_totals(side, keys, [*[F.col(f"__k{i}") for i in range(len(order))], F.col("id")], {"place": F.lit(1)})
    waiting = cut(ranked.select(*keys, "id", "place", *CORNERS, F.floor((F.col("place") - 1) / batch).alias("batch")))
    images = waiting.select(*keys).distinct()
    free = null_safe_join(targets.select("image_id", F.col(target_id).alias("gt"), *CORNERS), images, ["image_id"])
    free = cut(free.select(*keys, "gt", *CORNERS))
    schema = waiting.select(*keys, "id").join(targets.limit(0).select(F.col(target_id).alias("target")), F.lit(True)).withColumn("best_iou", F.lit(0.0)).schema
    top = waiting.agg(F.max("batch")).first()[0]
    done = []
    for now in range(0 if top is None else top + 1):
        def run(rows: pd.DataFrame, truth: pd.DataFrame) -> pd.DataFrame:
            rows, truth = rows.sort_values("place", ignore_index=True), truth.sort_values("gt", ignore_index=True)
            held, names = Free(truth[list(CORNERS)].to_numpy()), truth["gt"].tolist()
            target, best = [None] * len(rows), np.zeros(len(rows))
            for i, box in enumerate(zip(*(rows[c].tolist() for c in CORNERS))):
                found, best[i] = held.best(box)
                if found >= 0 and best[i] >= threshold:
                    target[i] = names[found]
                    held.take(found)
            rows["target"], rows["best_iou"] = pd.array(target, dtype="Int64") if truth["gt"].dtype.kind == "i" else target, best
            return rows[schema.names]

        found = waiting.filter(F.col("batch") == now).groupBy(*keys).cogroup(free.groupBy(*keys)).applyInPandas(run, schema)
        done.append(cut(found))
        if now < top:
            taken = done[-1].filter("target IS NOT NULL").select(*keys, F.col("target").alias("gt"))
            free = cut(null_safe_join(free, taken, [*keys, "gt"], "left_anti"))
    matched = reduce(DataFrame.unionByName, done) if done else seekers.sparkSession.createDataFrame([], schema)
    return null_safe_join(seekers.withColumn("id", F.col(seeker_id)), matched, [*keys, "id"]).select(*seekers.columns, "target", "best_iou")


def overlap_counts(boxes: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """Pairs of boxes of an image with IoU of ``threshold`` or more, counted and never listed: image_id, pairs.

    Equal boxes fall together first and count by their number. The distinct ones of an image are dealt to blocks, and blocks
    meet pair by pair in tiles of bounded size; most images are one tile, and a task counts many tiles in the same array rounds.
    """
    merged = boxes.filter(has_area() & F.col("image_id").isNotNull()).groupBy("image_id", *CORNERS).agg(F.count(F.lit(1)).alias("w"))
    merged = cut(merged)
    sizes = merged.groupBy("image_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.sum(F.col("w") * (F.col("w") - 1) / 2).cast("bigint").alias("same"))
    dealt = merged.join(sizes.select("image_id", "blocks"), "image_id").withColumn("own", F.pmod(F.xxhash64(*CORNERS), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # within a block side is 0 for all; between two blocks it tells them apart
    dealt = dealt.select("image_id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), *CORNERS, "w")
    dealt = dealt.repartition("image_id", "low", "high").sortWithinPartitions("image_id", "low", "high", "x1")
    schema = T.StructType([boxes.schema["image_id"], T.StructField("pairs", T.LongType())])
    found = dealt.mapInArrow(lambda it: count_tiles(threshold, it), schema).groupBy("image_id").agg(F.sum("pairs").alias("pairs"))
    same = F.col("same") if threshold <= 1 else F.lit(0)
    return sizes.join(found, "image_id").select("image_id", (F.col("pairs") + same).alias("pairs")).filter("pairs > 0")
