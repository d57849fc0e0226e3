import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameops.lineage import scratch
from frameops.operators import matching as M
from frameops.operators import models as L
from frameops.operators import policy as D
from frameops.operators.skyline import front, skyline
from frameops.streaming import jobs
from tests.test_boxes import GT, PRED, random_boxes


def test_threshold_search_equals_matching_at_every_threshold(spark):
    preds, gts = random_boxes(7, images=3, n=12)
    pred, gt = spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT)
    truth = gt.agg(F.count("*").alias("ground_truth_boxes"))
    matches = M.match_greedy(pred, gt).select(F.col("score").alias("probability"), "true_positive")
    row = L.choose_threshold(matches, truth, [], 0.1, 0.9, 9).first()
    scores = []
    for i in range(9):
        t = 0.1 + i * ((0.9 - 0.1) / 8)
        r = M.average_precision(M.match_greedy(pred.filter(F.col("score") >= t), gt), truth).first()
        scores.append((round(0.65 * r["recall"] + 0.25 * r["f1"] + 0.10 * r["precision"], 9), -i, t))
    assert row["composite"] == pytest.approx(max(scores)[0]) and row["threshold"] == pytest.approx(max(scores)[2])


def test_label_cv_learns_a_separable_label(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "image_id bigint, a double, b double").withColumn("y", (F.col("a") > 0.6).cast("int"))
    out = L.label_cv(df, ["a", "b"], "y", folds=3).collect()
    assert len({r["image_id"] for r in out}) == len(out) == 300
    assert sum(r["label"] == r["prediction"] for r in out) / 300 > 0.9


@pytest.mark.parametrize("task_rows,keys", [(200_000, ["g"]), (7, ["g"]), (3, [])])
def test_pareto_equals_pairwise_rule(spark, task_rows, keys):
    rnd = random.Random(11)
    rows = [(i, f"g{i % 2}" if i % 3 else None, rnd.randrange(12), rnd.randrange(12), rnd.randrange(12), rnd.choice([1, 2])) for i in range(150)]
    rows += [(150, "g0", None, 50, 50, 2), (151, "g0", 13, 0, 0, 1), (152, "g0", 13, 0, 0, 1)]
    df = spark.createDataFrame(rows, "id int, g string, a int, b int, c int, d int").repartition(5)
    beats = lambda p, q: (not keys or p[1] == q[1]) and None not in p[2:] and all(x >= y for x, y in zip(p[2:], q[2:])) and p[2:] != q[2:]
    whole = [r for r in rows if None not in r[2:]]
    got = {r["id"] for r in D.pareto(df, ["a", "b", "c", "d"], keys, task_rows).filter("pareto").collect()}
    assert got == {q[0] for q in whole if not any(beats(p, q) for p in whole)}


def test_skyline_of_a_hundred_thousand(spark):
    """All rows of a plane are incomparable; those below it are dominated."""
    plane = spark.range(100_000).select((F.col("id") % 320).alias("a"), F.floor(F.col("id") / 320).alias("b")).withColumn("c", 1000 - F.col("a") - F.col("b"))
    below = plane.limit(30_000).select("a", "b", (F.col("c") - 1).alias("c"))
    best = skyline(plane.union(below), ["a", "b", "c"], task_rows=30_000)
    assert best.count() == 100_000 and best.filter("a + b + c < 1000").isEmpty()


@pytest.mark.parametrize("width,top", [(1, 9), (2, 30), (3, 8), (4, 5), (5, 3)])
def test_front_equals_pairwise_rule(width, top):
    rng = np.random.default_rng(width)
    values, group = rng.integers(0, top, (700, width)).astype(float), rng.integers(0, 3, 700)
    worse = (values[:, None] <= values[None]).all(2) & (values[:, None] < values[None]).any(2) & (group[:, None] == group[None])
    assert front(values, group).tolist() == np.flatnonzero(~worse.any(1)).tolist()


def test_every_objective_route_is_reachable(spark):
    fields = "objective string, compute_profile string, face_count int, dominant_height int, face_risk string, text_risk string, screen_risk string, artifact_risk string, quality_condition string, pose_condition string"
    base = ("cpu_or_very_low_resource", 2, 200, "high", "none", "none", "low_method_failure_risk", "clean", "unknown")
    rows = [(o, *base) for o in ("privacy_first", "utility_priority", "runtime_aware", "compute_profile_adaptive", "failure_avoidance", "multimodal_risk")]
    rows.append(("utility_priority", *base[:3], "possible", *base[4:]))
    rows.append(("privacy_first", base[0], 0, 0, "none", *base[4:]))
    got = [r["selected_method"] for r in D.objective_router(spark.createDataFrame(rows, fields)).collect()]
    assert got == ["solid_mask", "blur", "layered", "blur", "layered", "blur", "pixelate", "copy"]


def write_stream_input(spark, batches, schema):
    path = scratch(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


def test_resume_keeps_one_row_per_pair(spark):
    t = datetime(2024, 1, 1)
    schema = "ts timestamp, relative_path string, method string"
    path = write_stream_input(spark, [[(t, "a", "blur"), (t, "b", "blur")], [(t + timedelta(minutes=5), "a", "blur"), (t, "a", "mask")]], schema)
    out, ck = scratch(spark, "out"), scratch(spark, "ck")
    source = jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1)
    jobs.stream_resume(source, out, ck).awaitTermination()
    assert sorted((r[0], r[1]) for r in spark.read.parquet(out).select("relative_path", "method").collect()) == [("a", "blur"), ("a", "mask"), ("b", "blur")]
    # a second run continues from the checkpoint and repeats nothing
    jobs.stream_resume(jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_late_rows_are_dropped_after_the_watermark(spark):
    t = datetime(2024, 1, 1)
    schema = "ts timestamp, method string, failed boolean"
    first, later, late = [(t, "blur", True)], [(t + timedelta(hours=5), "blur", False)], [(t + timedelta(minutes=1), "blur", False)]
    # the watermark of one batch takes effect on late rows two batches on
    pause = [(t + timedelta(hours=6), "blur", False)]
    path = write_stream_input(spark, [first, later, pause, late, [(t + timedelta(hours=9), "blur", False)]], schema)
    out = scratch(spark, "out")
    source = jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1)
    jobs.stream_method_mix(source, out, scratch(spark, "ck"), width="1 hour", late="10 minutes").awaitTermination()
    rows = {r["window_start"]: r for r in spark.read.parquet(out).collect()}
    assert rows[t]["n"] == 1 and rows[t]["failure_rate"] == 1.0


def test_stream_route_separates_unusable_frames(spark):
    schema = "image_id bigint, face_size_px bigint, blur_score double"
    path = write_stream_input(spark, [[(1, 50, 1.0), (2, 300, 1.0)], [(3, 300, None), (4, 300, 900.0)]], schema)
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    source = jobs.file_stream(spark, path, spark.read.parquet(path).schema, 1)
    jobs.stream_route(source, good, bad, scratch(spark, "ck")).awaitTermination()
    assert {r["image_id"]: r["method"] for r in spark.read.parquet(good).collect()} == {1: "blur", 2: "pixelate", 4: "blur"}
    assert [r["image_id"] for r in spark.read.parquet(bad).collect()] == [3]
