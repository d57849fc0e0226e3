"""Precision over ranked rows in blocks of ranges, notes of images, and the disk that matching and ranking leave."""

import math
import random

from pyspark.sql import functions as F

from frameops.operators import matching, policy, ranges


def shuffled_bytes(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def boxes(spark, n):
    rows = spark.range(n).select((F.col("id") % (n // 5)).alias("image_id"), F.col("id").alias("pred_id"), (F.col("id") * 7 % 97 / 97.0).alias("score"),
                                 *[(F.col("id") * k % 1999 + a).alias(c) for c, k, a in (("x1", 13, 0), ("y1", 17, 0), ("x2", 13, 90), ("y2", 17, 80))],
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = spark.createDataFrame(rows.collect(), "image_id long, pred_id long, score double, x1 long, y1 long, x2 long, y2 long, source string")
    return rows, rows.filter("pred_id % 3 = 0").withColumnRenamed("pred_id", "gt_id").drop("score", "source")


def test_subgroup_scores_leave_no_shuffles_of_boxes(spark):
    pred, gt = boxes(spark, 40_000)
    groups = pred.select("image_id").distinct().select("image_id", F.when(F.col("image_id") % 3 == 0, "x").otherwise("y").alias("subgroup"))
    before = shuffled_bytes(spark)
    out = matching.score_subgroups(pred, gt, groups, "source")
    counts = {(r["source"], r["subgroup"]): r["prediction_boxes"] for r in out.collect()}
    assert sum(counts.values()) == 40_000
    # 1.1 MB stayed when shuffles were left to the driver's garbage collection; those of small joins still do
    assert shuffled_bytes(spark) - before < 600_000


def test_precision_ranks_ties_nan_and_null_as_sql_does(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    rng = random.Random(3)
    rows = [(i % 23, i, rng.choice([0.5, 0.25, math.nan, None, rng.random(), -0.0, 0.0]), rng.random() < 0.4, rng.choice("ab")) for i in range(900)]
    matches = spark.createDataFrame(rows, "image_id long, pred_id long, score double, true_positive boolean, source string")
    truth = spark.createDataFrame([("a", 300), ("b", 300), ("c", 5)], "source string, ground_truth_boxes long")
    matches.createOrReplaceTempView("ranked_matches")
    want = spark.sql("""SELECT source, sum(CASE WHEN true_positive THEN hits / seen END) / 300 AS ap FROM (SELECT *, sum(int(true_positive)) OVER w AS hits, row_number() OVER w AS seen
        FROM ranked_matches WINDOW w AS (PARTITION BY source ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)) GROUP BY source""")
    want = {r["source"]: r["ap"] for r in want.collect()} | {"c": 0.0}
    got = {r["source"]: r["ap"] for r in matching.average_precision(matches, truth, ["source"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    text = matches.withColumn("image_id", F.concat(F.lit("i"), F.lpad(F.col("image_id").cast("string"), 3, "0")))
    again = {r["source"]: r["ap"] for r in matching.average_precision(text, truth, ["source"]).collect()}
    assert all(abs(again[k] - want[k]) < 1e-12 for k in want)


def test_notes_select_and_mark_the_seekers_of_an_image(spark):
    pred, gt = boxes(spark, 2_000)
    notes = pred.select("image_id").distinct().filter("image_id % 2 = 0").select("image_id", (F.col("image_id") * 10).alias("note"))
    keep = ["image_id", "pred_id", "score"]
    for limit in (1_000, 3):
        plain = matching.match_greedy(pred, gt, limit=limit).join(notes, "image_id").select(*keep, "gt_id", "note")
        noted = matching.match_greedy(pred, gt, limit=limit, keep=keep, notes=notes).select(*keep, "gt_id", "note")
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, noted.collect()), key=str)


def test_abstaining_router_keeps_frames_without_an_option(spark):
    labels = spark.createDataFrame([(1, "overall"), (1, "s"), (2, "overall"), (3, "overall"), (3, "t"), (3, "s"), (4, "u")], "image_id long, subgroup string")
    best = spark.createDataFrame([("overall", "m", 0.5, 0.5), ("s", "n", 0.7, 0.6), ("t", "o", 0.4, 0.9)], "subgroup string, model string, score double, recall double")
    out = policy.abstaining_router(labels, best, best.filter("subgroup = 'overall'"))
    assert {r["image_id"]: (r["selected_subgroup"], r["selected_model"], r["abstained"]) for r in out.collect()} == {
        1: ("s", "n", False), 2: ("overall", "m", True), 3: ("s", "n", False), 4: ("overall", "m", True)}


def test_truth_of_a_wider_type_keeps_its_values(spark):
    pred = spark.createDataFrame([(1, 5, 0.5, 0, 0, 10, 10)], "image_id int, pred_id int, score double, x1 int, y1 int, x2 int, y2 int")
    gt = spark.createDataFrame([(1, 7, 0, 0, 10, 10), (2**40, 8, 0, 0, 2**40, 10)], "image_id long, gt_id long, x1 long, y1 long, x2 long, y2 long")
    out = matching.match_greedy(pred, gt)
    assert dict(out.dtypes)["x1"] == "int" and [(r["image_id"], r["gt_id"], r["x2"]) for r in out.collect()] == [(1, 7, 10)]
