"""One job from candidate boxes to the routing ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.operators.boxes import fuse
from frameops.operators.policy import NO_ACTION, rule_router


def profile_batch(boxes: DataFrame, frames: DataFrame, scored: DataFrame, face_size: float = 120, blur: float = 350) -> DataFrame:
    """Boxes are fused, frames routed, the routed method's metrics looked up, and the ledger summed per method.

    ``frames``: image_id, blur_score.  ``scored``: one row per (image_id, method).
    """
    c = F.col
    side = F.least(c("x2") - c("x1"), c("y2") - c("y1"))
    per_frame = fuse(boxes).groupBy("image_id").agg(F.count(F.lit(1)).alias("face_count"), F.max(side).alias("face_size_px"))
    rows = frames.select("image_id", "blur_score").join(per_frame, "image_id", "left").fillna(0, ["face_count", "face_size_px"])
    routed = rule_router(rows, face_size, blur)
    idle = c("face_count") == 0
    routed = routed.withColumn("method", F.when(idle, NO_ACTION).otherwise(c("method")))
    joined = routed.join(scored.select("image_id", "method", "privacy_score", "utility_score", "success"), ["image_id", "method"], "left")
    one = lambda k: F.avg(F.when(c("method") == NO_ACTION, 1.0).otherwise(c(k)))
    return joined.groupBy("method").agg(F.count(F.lit(1)).alias("frames"), one("privacy_score").alias("mean_privacy"), one("utility_score").alias("mean_utility"),
                                        F.count_if(c("success") == 0).alias("failures"))
