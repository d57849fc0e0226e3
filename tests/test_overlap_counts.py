"""Overlap counts (J06) of many small images in common array rounds."""

import random

import numpy as np
import pyarrow as pa

from frameops.operators import rounds
from frameops.operators.crowded import overlap_counts
from tests import brute


def test_many_small_images_take_few_array_rounds(monkeypatch):
    """The rounds are as many as near boxes of one image, not as images: before, each image was a tile of its own."""
    n = 20_000
    table = pa.table({"image_id": np.repeat(np.arange(n), 3), "low": np.zeros(3 * n, np.int32), "high": np.zeros(3 * n, np.int32), "side": np.zeros(3 * n, np.int32),
                      "x1": np.tile([0, 1, 500], n), "y1": np.zeros(3 * n, np.int64), "x2": np.tile([100, 101, 600], n), "y2": np.full(3 * n, 100), "w": np.tile([2, 3, 1], n)})
    calls = []
    real = rounds.near_weights
    monkeypatch.setattr(rounds, "near_weights", lambda *a: calls.append(1) or real(*a))
    out = pa.Table.from_batches(list(rounds.count_tiles(0.5, iter(table.to_batches(max_chunksize=1000)))))
    assert out.num_rows == n and set(out["pairs"].to_pylist()) == {6}
    assert len(calls) <= 3


def test_overlap_counts_of_doubles_and_blocks(spark):
    rnd = random.Random(3)
    rows = [(i % 3, float(x), float(y), x + rnd.random() * 40, y + rnd.random() * 40) for i in range(150) for x, y in [(rnd.randrange(60), rnd.randrange(60))]]
    rows.append((0, 1.0, 1.0, float("nan"), 30.0))
    df = spark.createDataFrame(rows, "image_id bigint, x1 double, y1 double, x2 double, y2 double")
    want = {}
    named = [dict(zip(("image_id", "x1", "y1", "x2", "y2"), r)) for r in rows[:-1]]
    for i, a in enumerate(named):
        for b in named[:i]:
            if a["image_id"] == b["image_id"] and brute.iou(a, b) >= 0.4:
                want[a["image_id"]] = want.get(a["image_id"], 0) + 1
    for block in (4096, 7):
        assert {r.image_id: r.pairs for r in overlap_counts(df, 0.4, block).collect()} == want
