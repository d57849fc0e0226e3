"""Findings of round 3 on boxes and models at size."""

import random

from pyspark.sql import functions as F


def test_clusters_of_small_images_in_one_pass(spark):
    """Array rounds give the rows of the fold in the JVM, with null images, ids and scores; and cluster in one shuffle."""
    from frameops.operators import boxes as X
    from frameops.operators import greedy as G

    rng = random.Random(3)
    rows = []
    for i in range(900):
        x, y = rng.randrange(60), rng.randrange(60)
        corners = [x, y, x + rng.randrange(40), y + rng.randrange(40)]
        score = None if rng.random() < 0.05 else rng.randrange(20) / 20
        rows.append((rng.choice([None, 1, 2, 3, *range(4, 40)]), None if rng.random() < 0.02 else i, rng.choice("cab"), *corners, score, rng.choice([None, "u", "v"])))
    boxes = spark.createDataFrame(rows, "image_id long, pred_id long, source string, x1 long, y1 long, x2 long, y2 long, score double, model string").repartition(3)
    for extra, fixed in (((), None), (("model",), None), ((), F.col("source") == "a")):
        order = X.by_score() if fixed is None else [F.when(fixed, 0).otherwise(1), *X.by_score()]
        got = G._suppress_in_rounds(boxes, 0.3, order, "pred_id", extra, fixed).collect()
        want = G._suppress_in_arrays(boxes, 0.3, order, "pred_id", extra, fixed).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
    for extra in ((), ("model",)):
        boxes = boxes.filter("pred_id IS NOT NULL")
        got = X.cluster_boxes(boxes, 0.3, extra)
        summed = G._summed(G._suppress_in_arrays(boxes, 0.3, X.by_score(), "pred_id", extra, None), 1e-6, extra)
        pick = lambda df: sorted(str(r) for r in df.select("image_id", *extra, "cluster_id", "score", "members", "source_scores").collect())
        assert pick(got) == pick(summed)
        means = {(r.image_id, r.cluster_id, *(r[e] for e in extra)): tuple(r[c] for c in ("x1", "y1", "x2", "y2")) for r in got.collect()}
        assert means == {(r.image_id, r.cluster_id, *(r[e] for e in extra)): tuple(round(round(r[f"s_{c}"] / r["s_w"], 9)) for c in ("x1", "y1", "x2", "y2")) for r in summed.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan, plan
