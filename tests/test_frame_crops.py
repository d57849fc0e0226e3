"""Crops of A09 are dealt by number, so that a task's table of sums does not grow with the input."""

from pyspark.sql import functions as F

from frameops.operators import features as A


def test_crops_of_a_task_are_bounded(spark):
    boxes = spark.range(3000).select((F.col("id") % 600).alias("image_id"), (F.col("id") / 3000).alias("score"))
    metrics = spark.range(600).select(F.col("id").alias("image_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("method"), (F.col("id") / 600).alias("reid"))
    crops = A.frame_crops(metrics, boxes, per_task=50).withColumns({"cosine": F.col("reid") * F.col("score"), "hit": F.lit(1.0), "part": F.spark_partition_id()})
    tasks = crops.groupBy("part").count().collect()
    assert len(tasks) > 40 and max(r["count"] for r in tasks) <= 6 * 50 * 2
    plain = metrics.join(boxes, "image_id").groupBy("image_id", "method").agg(F.avg(F.col("reid") * F.col("score")).alias("m"), F.count(F.lit(1)).alias("n"))
    got = {(r[0], r[1]): (round(r["cosine_mean"], 9), r["face_crop_count"]) for r in A.reid_per_frame(crops).collect()}
    assert got == {(r[0], r[1]): (round(r["m"], 9), r["n"]) for r in plain.collect()}
