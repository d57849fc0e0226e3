"""Images with many boxes: stacks, chains and batches against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from frameops.operators.crowded import assign_in_batches, overlap_counts, suppress_in_batches
from frameops.operators.boxes import by_score, cluster_boxes, nms
from frameops.operators.matching import match_greedy
from tests import brute
from tests.test_boxes import GT, PRED, by_image, random_boxes


@pytest.mark.parametrize("threshold,batch", [(0.5, 7), (0.45, 20), (0.3, 3), (0.9, 10), (0.5, 100_000)])
def test_suppression_in_batches(spark, threshold, batch):
    preds, _ = random_boxes(3, images=3, n=20, span=200)
    preds += [(0, 900_000 + i, "z", 5, 5, 5 + i % 2, 9, 0.5) for i in range(5)]
    df = spark.createDataFrame(preds, PRED)
    got = {(r.image_id, r.pred_id): r.seed for r in suppress_in_batches(df, threshold, by_score(), "pred_id", [], None, batch).collect()}
    want = {(image, p): s for image, rows in by_image(df).items() for p, s in brute.seeds(rows, threshold).items()}
    assert got == want


@pytest.mark.parametrize("batch", [4, 100_000])
def test_matching_in_batches(spark, batch):
    preds, gts = random_boxes(5, images=3, n=20, span=500)
    df, gt = spark.createDataFrame(preds, PRED), spark.createDataFrame([g for g in gts if g[0] != 1], GT)
    got = {(r.source, r.image_id, r.pred_id): (r.target, round(r.best_iou, 9)) for r in assign_in_batches(df, gt, 0.5, by_score(), "pred_id", "gt_id", ["source"], batch).collect()}
    truth, want = by_image(gt), {}
    for image, rows in by_image(df).items():
        for source in {r["source"] for r in rows}:
            found = brute.greedy_match([r for r in rows if r["source"] == source], truth.get(image, []), 0.5)
            want |= {(source, image, p): (g, round(v, 9)) for p, (g, v) in found.items()}
    assert got == want


def test_fixed_rows_stay(spark):
    rows = [(1, i, "s", 0, 0, 10, 10, 0.5) for i in range(12)]
    df = spark.createDataFrame(rows, PRED).withColumn("stage", (F.col("pred_id") >= 6).cast("int"))
    got = {r.pred_id: r.seed for r in suppress_in_batches(df, 0.5, [F.col("stage"), F.col("pred_id")], "pred_id", [], F.col("stage") == 0, 4).collect()}
    assert got == {i: i if i < 6 else 0 for i in range(12)}


def test_stack_of_a_hundred_thousand(spark):
    stack = spark.range(100_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("pred_id"), F.lit("s").alias("source"),
                                        *[(F.lit(v) + F.col("id") % 3).cast("long").alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (100, 100, 400, 400))], F.lit(0.5).alias("score"))
    assert [r.pred_id for r in nms(stack).collect()] == [0]
    assert [r.members for r in cluster_boxes(stack).collect()] == [100_000]
    gt = spark.createDataFrame([(1, g, 100, 100, 400, 400) for g in range(50)], GT)
    matched = match_greedy(stack, gt)
    assert matched.filter("true_positive").agg(F.count("*"), F.count_distinct("gt_id"), F.max("pred_id")).first()[:2] == (50, 50)
    assert matched.count() == 100_000


def test_chain_of_ten_thousand(spark):
    """Each box overlaps the next by the threshold: kept and captured ones alternate along the order."""
    rng = random.Random(1)
    rows = [(1, i, "s", 30 * i, 0, 30 * i + 100, 100, 1 - i / 20_000) for i in range(10_000)]
    rng.shuffle(rows)
    kept = {r.pred_id for r in nms(spark.createDataFrame(rows, PRED)).collect()}
    assert kept == set(range(0, 10_000, 2))


@pytest.mark.parametrize("block", [4096, 5])
def test_overlap_counts(spark, block):
    preds, _ = random_boxes(9, images=3, n=20, span=150)
    preds += [(0, 900_000 + i, "z", 5, 5, 50, 90, 0.5) for i in range(6)] + [(7, 1, "z", 0, 0, 9, 9, 0.5), (8, 1, "z", 0, 0, 0, 9, 0.5), (8, 2, "z", 0, 0, 0, 9, 0.5)]
    df = spark.createDataFrame(preds, PRED)
    want = {}
    for image, rows in by_image(df).items():
        n = sum(brute.iou(a, b) >= 0.4 for i, a in enumerate(rows) for b in rows[:i])
        want |= {image: n} if n else {}
    assert {r.image_id: r.pairs for r in overlap_counts(df, 0.4, block).collect()} == want


def test_overlap_counts_of_a_stack(spark):
    """100,000 boxes, 20,000 of them distinct: counted without listing five thousand million pairs."""
    i = F.col("id") % 20_000
    stack = spark.range(100_000).select(F.lit(1).alias("image_id"), *[(F.lit(v) + s).cast("long").alias(c) for c, v, s in zip(
        ("x1", "y1", "x2", "y2"), (0, 0, 10_000, 10_000), (i % 100, F.floor(i / 100), i % 100, F.floor(i / 100)))])
    assert overlap_counts(stack, 0.5).first().pairs == 100_000 * 99_999 // 2
