"""Pixel operators on frames of several strips against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameops.operators import raster as P

H, W = 150, 40


@pytest.fixture(scope="module")
def frame(spark):
    v = np.random.default_rng(8).integers(0, 256, (2, H, W))
    rows = [(f"f{i}", r, c, int(v[i, r, c])) for i in range(2) for r in range(H) for c in range(W)]
    px = spark.createDataFrame(rows, "image_id string, row int, col int, v int").repartition(5).cache()
    boxes = [("f0", 3, 5, 60, 20, 70), ("f0", 7, 15, 50, 45, 131), ("f0", 9, 0, 0, 0, 90), ("f1", 1, -5, 120, 8, 400), ("none", 1, 0, 0, 5, 5)]
    return v, px, spark.createDataFrame(boxes, "image_id string, box_id int, x1 int, y1 int, x2 int, y2 int"), boxes


def owner(boxes, image):
    out = np.full((H, W), -1)
    for name, box, x1, y1, x2, y2 in sorted(boxes, key=lambda b: -b[1]):
        if name == image and x2 > x1:
            out[max(0, y1) : y2, max(0, x1) : x2] = box
    return out


def dense(df):
    out = np.full((2, H, W), np.nan)
    rows = df.collect()
    assert len(rows) == 2 * H * W
    for r in rows:
        out[int(r.image_id[1]), r.row, r.col] = r.v
    return out


def blurred(v, radius):
    out = np.zeros(v.shape)
    for r in range(H):
        for c in range(W):
            out[r, c] = v[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1].mean()
    return out


def test_inside_boxes(frame):
    v, px, boxes, plain = frame
    fill, blur, tiles = dense(P.raster_fill(px, boxes, 9)), dense(P.raster_blur(px, boxes, 3)), dense(P.raster_pixelate(px, boxes, 7))
    for i in range(2):
        own = owner(plain, f"f{i}")
        assert (fill[i] == np.where(own >= 0, 9, v[i])).all()
        assert np.allclose(blur[i], np.where(own >= 0, blurred(v[i], 3), v[i]))
        want = v[i].astype(float)
        for name, box, x1, y1, _, _ in plain:
            row, col = np.nonzero((own == box) & (name == f"f{i}"))
            tile = [((r - y1) // 7, (c - x1) // 7) for r, c in zip(row, col)]
            for t in set(tile):
                at = [k for k, x in enumerate(tile) if x == t]
                want[row[at], col[at]] = np.floor(v[i][row[at], col[at]].mean())
        assert (tiles[i] == want).all()


def test_measures(frame):
    v, px, boxes, plain = frame
    got = {r.image_id: r for r in P.raster_quality(px, 100, 200).collect()}
    steps = {r.image_id: r for r in P.raster_blockiness(px, 8).collect()}
    kept = {r.image_id: r.background_preservation for r in P.background_preservation(px, P.raster_blur(px, boxes.limit(0), 0).withColumn("v", F.col("v") + 5), boxes).collect()}
    for i in range(2):
        x, r = v[i].astype(float), got[f"f{i}"]
        mirrored = np.pad(x, 1, mode="reflect")
        lap = mirrored[1:-1, :-2] + mirrored[1:-1, 2:] + mirrored[:-2, 1:-1] + mirrored[2:, 1:-1] - 4 * x
        assert np.allclose([r.brightness, r.contrast, r.laplacian_variance, r.dark_share, r.bright_share], [x.mean(), x.std(), lap.var(), (x < 100).mean(), (x > 200).mean()])
        across, down = np.abs(np.diff(x, axis=1)).mean(0), np.abs(np.diff(x, axis=0)).mean(1)
        at = lambda d, offsets: np.mean([d[k - 1] for k in range(1, len(d) + 1) if k % 8 in offsets])
        score = at(across, (0,)) + at(down, (0,)) - at(across, (1, 4)) - at(down, (1, 4))
        assert np.isclose(steps[f"f{i}"].blockiness, max(0, score))
        assert np.isclose(kept[f"f{i}"], 1 - 5 / 255)


def test_full_frame(spark):
    """3840 x 2160 pixels: one pass over strips, and one for measures."""
    px = spark.range(3840 * 2160, numPartitions=8).select(F.lit(1).alias("image_id"), F.floor(F.col("id") / 3840).alias("row"), (F.col("id") % 3840).alias("col"))
    px = px.withColumn("v", (F.col("row") * 7 + F.col("col") * 3) % 256)
    box = spark.createDataFrame([(1, 1, 100, 50, 3700, 2100)], "image_id int, box_id int, x1 int, y1 int, x2 int, y2 int")
    soft = P.raster_blur(px, box, 4).agg(F.count("*"), F.sum("v")).first()
    v = (np.arange(2160)[:, None] * 7 + np.arange(3840)[None] * 3) % 256
    want = v.astype(float)
    want[50:2100, 100:3700] = (P._sums(v.astype(float), 4) / P._sums(np.ones(v.shape), 4))[50:2100, 100:3700]
    assert soft[0] == 3840 * 2160 and np.isclose(soft[1], want.sum())
    row = P.raster_quality(px).first()
    assert np.isclose(row.brightness, v.mean()) and np.isclose(row.contrast, v.std())
