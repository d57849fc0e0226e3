"""Sweeps without copies against one scoring per grid point."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameops.functions.geometry import postfilter_drop
from frameops.operators import boxes, ranked
from frameops.operators.matching import average_precision, match_greedy, match_gt_order

BOXES = "image_id long, pred_id long, x1 long, y1 long, x2 long, y2 long, score double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    truth, pred, other = [], [], []
    for image in range(60):
        for g in range(rng.randrange(4)):
            x, y, s = rng.choice([0, 5, 300, 900]), rng.choice([0, 20, 500]), rng.choice([60, 200, 300])
            truth.append((image, image * 10 + g, x, y, x + s, y + s))
            for rows in (pred, other):
                for _ in range(rng.randrange(3)):
                    dx = rng.choice([0, 4, 30])
                    rows.append((image, len(pred) + len(other) * 100_000, x + dx, y, x + dx + s, y + s, rng.choice([0.2, 0.4, 0.5, 0.9])))
    frames = spark.createDataFrame([(i, 1000, float(i % 20)) for i in range(70)], "image_id long, height long, text_score double")
    return (spark.createDataFrame(pred, BOXES).cache(), spark.createDataFrame(other, BOXES).cache(),
            spark.createDataFrame(truth, "image_id long, gt_id long, x1 long, y1 long, x2 long, y2 long").cache(), frames.cache())


def direct(pred, gt):
    row = average_precision(match_greedy(pred, gt), gt.agg(F.count(F.lit(1)).alias("ground_truth_boxes"))).first()
    return [round(row[c], 9) for c in ("ap", "precision", "recall", "f1")] + [row[c] for c in ("true_positives", "false_positives", "false_negatives")]


def swept(row):
    return [round(row[c], 9) for c in ("ap", "precision", "recall", "f1")] + [row[c] for c in ("true_positives", "false_positives", "false_negatives")]


def test_postfilter(tables):
    pred, _, gt, _ = tables
    rows = boxes.sweep_postfilter(pred, gt, (0, 8, 2000), (100, 250), (0.3, 0.6)).collect()
    assert len(rows) == 12 and len({tuple(swept(r)) for r in rows}) > 3
    for r in rows:
        gone = postfilter_drop(r.edge_margin_px, r.large_min_side_px, r.max_score)
        assert swept(r) == direct(pred.filter(~gone), gt)
        assert r.removed_count == pred.filter(gone).count()


def test_label_subsets(spark, tables):
    pred, other, gt, frames = tables
    labels = ("a", "b", "c")
    condition = frames.select("image_id", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("image_id") % 4 + 1).cast("int")).alias("condition_label"))
    rows = {r.trigger_labels: r for r in boxes.fallback_by_label(pred, other, gt, condition, labels).collect()}
    assert len(rows) == 7 and rows["a"].grid_id == 1 and rows["a|b|c"].grid_id == 7
    for held in ("a", "b|c", "a|b|c"):
        triggered = condition.filter(F.col("condition_label").isin(held.split("|")))
        merged = boxes.fallback_merge(pred, other, triggered)
        assert swept(rows[held]) == direct(merged, gt) and rows[held].triggered_images == triggered.count()
        complete = match_gt_order(merged, gt).groupBy("image_id").agg(F.bool_and("matched").alias("ok")).collect()
        good = sum(r.ok for r in complete)
        assert (rows[held].images_fully_correct, rows[held].images_with_missed_faces) == (good, len(complete) - good)
        assert rows[held].image_level_full_match_rate == good / 70


def test_no_images(tables):
    pred, other, gt, frames = tables
    rows = boxes.sweep_fallback(pred.limit(0), other.limit(0), gt.limit(0), frames.limit(0), (24.0,), (0.6,), (8.0, 9.0)).collect()
    assert [(r.ap, r.triggered_images, r.images_fully_correct, r.image_level_full_match_rate) for r in rows] == [(0.0, 0, 0, 0.0)] * 2


def test_keys_stay_whole():
    """A key whose rows arrive in several batches counts once."""
    batches = [pa.record_batch({"score": [0.5], "image_id": [1], "pred_id": [i // 3], "hit": [1], "sign": [s], "grids": pa.array([g], pa.list_(pa.int32())), "part": [0]})
               for i, (s, g) in enumerate([(1, None), (-1, [0]), (1, [0]), (1, None), (-1, [1]), (1, [2])])]
    found = list(ranked._blocks(3, iter(batches)))
    assert [b[1].tolist() for b in found] == [[[1, 1, 1]], [[1, 0, 2]]]


def test_equal_points_keep_the_first(spark):
    """Points that differ in the last bits alone are ties."""
    for parts in (1, 3, 7):
        rows = spark.createDataFrame([(g, 0.4 + (g % 2) * 1e-16, 0.6, 3, True) for g in (6, 2, 5)], "grid_id long, ap double, f1 double, false_positives long, viable boolean").repartition(parts)
        assert boxes.best_postfilter(rows).first().grid_id == 2
