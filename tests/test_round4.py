"""Findings of round 3: values on the edge of a whole number, noisy ties, joins and scores at size."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import frameops.plans.catalog  # noqa: F401
from frameops.operators import greedy
from frameops.operators import matching as M
from frameops.operators import sampling as S
from frameops.operators.reconstructed import verification_metrics
from frameops.plans.feature_queries import cross_similarity
from frameops.plans.registry import QUERIES
from frameops.plans.views import Views
from frameops.sources.scans import scan_subgroup_files


def test_pixels_in_single_precision(spark, tmp_path):
    """A component whose pixel is a whole number in single precision and just below it in double precision."""
    values = np.random.default_rng(3).uniform(-1, 1, 4_000_000).astype(np.float32)
    single = np.floor((values + np.float32(1)) * np.float32(127))
    odd = values[single != np.floor((values.astype(float) + 1) * 127.0)][:8].repeat(8)
    assert len(odd) == 64
    vector = F.array(*[F.lit(float(x)).cast("float") for x in odd])
    spark.range(1).select(F.col("id").alias("vec_id"), vector.alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r["v"] for r in Views(spark, str(tmp_path)).pixels.orderBy("row", "col").collect()]
    assert got == ((odd + np.float32(1)) * np.float32(127)).astype(np.int64).tolist()


def test_candidate_bank_noisy_ties(spark):
    """Equal scores whose sums differ in the last bits share a rank."""
    # 92.05, each by other parts
    parts = [(30.0, 1.0 + 0.05 + 1.0 + k / 100, k / 1000) for k in range(0, 60, 7)]
    rows = [(i, f"p{i}", f"d{i}", "s", t, 150.0 * x, y) for i, (t, x, y) in enumerate(parts)]
    assert len({t * 3.0 + min(b / 150.0, 10.0) - y * 10.0 for _, _, _, _, t, b, y in rows}) > 1
    df = spark.createDataFrame(rows, "image_id long, relative_path string, day_id string, camera_stream_id string, text_score double, blur_score double, screen_score double")
    df = df.withColumns({"visible_text_flag": F.lit(True), "motion_blur_flag": F.lit(False)})
    bank = S.candidate_bank(df, "relative_path", "visible_text").collect()
    assert len(bank) == len(rows)
    assert {r["label_confidence"] for r in bank} == {1.0}


def test_stream_mix_of_unordered_files(spark, tmp_path):
    """Files that do not follow each other in time: no row is dropped by the watermark of an earlier file."""
    for i, day in enumerate((30, 29, 3, 2, 15, 1)):
        ts = F.expr(f"timestamp_ntz'2024-01-{day:02d} 12:00:00'")
        part = spark.range(10).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        got = QUERIES["q02_stream_method_mix"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(r["n"] for r in got) == [10] * 4


def test_pareto_of_means_computed_once(spark, monkeypatch):
    """Means that come out a little differently each time still find themselves on their front."""
    noise = F.udf(lambda x: x + random.random() * 1e-12, "double").asNondeterministic()
    scored = Views.scored_metrics.func
    monkeypatch.setattr(Views, "scored_metrics", property(lambda v: scored(v).withColumn("privacy_score", noise("privacy_score"))))
    got = QUERIES["d14_pareto_methods"](spark, "/root/testdata/sf0.001").collect()
    assert {r["subgroup"] for r in got} == {r["subgroup"] for r in got if r["pareto"]}


def test_growing_sides_are_not_broadcast(spark):
    """Sides that grow with the input are merged, however small their files look."""
    sides = cross_similarity(Views(spark, "/root/testdata/sf0.001"))
    made = [QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("j01_metric_join", "j02_cross_view_pairs")]
    for df, key in ((made[0], "image_id"), (made[1], "day_id"), (sides[0], "egocentric_image_id"), (sides[1], "egocentric_image_id")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert f"SortMergeJoin [{key}" in plan, key


def test_verification_metrics_plain(spark):
    rng = np.random.default_rng(5)
    rows = [("m", float(rng.integers(0, 40)) / 40, int(p)) for p in rng.integers(0, 2, 400)]
    r = verification_metrics(spark.createDataFrame(rows, "method string, similarity double, positive int")).first()
    a, b = (np.array([s for _, s, p in rows if p == side]) for side in (1, 0))
    auc = ((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b))
    want = (auc, a.mean(), b.mean(), a.std(), b.std())
    got = [r[c] for c in ("auc", "mean_positive", "mean_negative", "std_positive", "std_negative")]
    assert np.allclose(got, want, atol=1e-12) and (r["positive_pairs"], r["negative_pairs"]) == (len(a), len(b))


def test_subgroup_scores_without_a_row_per_subgroup(spark, monkeypatch):
    """Overlapping subgroups, one without truth, tied scores: same scores as ranking a copy of each match per subgroup."""
    v = Views(spark, "/root/testdata/sf0.001")
    membership = v.membership.unionByName(v.frames.filter("image_id % 5 = 0").select("image_id", F.lit("odd 'name'").alias("subgroup")))
    pred = v.cand_boxes.withColumn("score", F.round("score", 1))
    args = (pred, v.gt_boxes, membership, "source")
    key = lambda r: (r["source"], r["subgroup"])
    monkeypatch.setattr(M, "MOST_SUBSETS", 3)
    want = sorted(M.score_subgroups(*args).collect(), key=key)
    monkeypatch.undo()

    def refused(*_args, **_kwargs):
        raise AssertionError("matches ranked per subgroup")

    monkeypatch.setattr(M, "running_totals", refused)
    got = sorted(M.score_subgroups(*args).collect(), key=key)
    assert len(got) == len(want) == 48
    for a, b in zip(got, want):
        for name in a.asDict():
            assert a[name] == b[name] or abs(a[name] - b[name]) < 1e-9, (name, a, b)


def test_assignment_in_rounds(spark):
    """Rounds over many images give what the fold over one image gives, with ties, nulls and several keys; truth is not folded."""
    rng = np.random.default_rng(11)
    corners = lambda: (lambda x, y: (x, y, x + int(rng.integers(0, 50)), y + int(rng.integers(0, 50))))(int(rng.integers(0, 60)), int(rng.integers(0, 60)))
    gt = [(i, j, *corners()) for i in range(60) for j in range(int(rng.integers(0, 6)))] + [(None, 1, 0, 0, 50, 50)]
    pred = [(i, k, s, *corners(), float(rng.integers(0, 4)) / 4) for i in range(70) for s in ("a", None, "b") for k in range(int(rng.integers(0, 7)))]
    pred += [(None, 1, "a", 0, 0, 50, 50, 0.5), (3, 99, "a", None, 0, 50, 50, 0.5)]
    p = spark.createDataFrame(pred, "image_id long, pred_id long, source string, x1 long, y1 long, x2 long, y2 long, score double").repartition(7)
    g = spark.createDataFrame(gt, "image_id long, gt_id long, x1 long, y1 long, x2 long, y2 long").repartition(5)
    args = (p, g, 0.3, [-F.col("score"), F.col("pred_id")], "pred_id", "gt_id", ["source"])
    rounds = greedy._assign_folded(*args)
    assert "MapInArrow" in rounds._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.select(*p.columns, "target", "best_iou").collect()))
    got = rows(rounds)
    want = rows(greedy._assign_in_arrays(*args))
    assert len(got) == len(want) == len(pred)
    assert sorted(set(got) - set(want)) == sorted(set(want) - set(got))


def test_stratified_sample_sorts_few_rows(spark, monkeypatch):
    """only rows near the quota are ranked; the sample is that of ranking all rows, null strata included."""
    rows = [(f"k{i}", None if i % 5 == 0 else "ab"[i % 2]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "key string, kind string")
    seen, top_k = [], S.top_k
    monkeypatch.setattr(S, "top_k", lambda d, *a: (seen.append(d.count()), top_k(d, *a))[1])
    got = {r["key"] for r in S.stratified_sample(df, "key", ["kind"], 50).collect()}
    assert len(got) == 50 and seen[0] < 2_000
    order = sorted(rows, key=lambda r: hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()[:16])
    assert got == {r[0] for kind in (None, "a", "b") for r in [x for x in order if x[1] == kind][: {None: 10, "a": 20, "b": 20}[kind]]}


def test_subgroup_files_of_one_write(spark, tmp_path):
    """F32: the folders that one partitioned write makes name the model, as files and plain folders do."""
    rows = spark.createDataFrame([("1", 0, 0, 9, 9, 0.5, m, f"{m}.csv") for m in ("yolo", "scrfd")], "image_id string, x1 long, y1 long, x2 long, y2 long, score double, detector_name string, model string")
    rows.write.partitionBy("model").csv(f"{tmp_path}/one", header=True)
    rows.drop("model").where("detector_name = 'yolo'").write.csv(f"{tmp_path}/two/a=b.csv", header=True)
    got = sorted((r["model"], r["detector_name"]) for r in scan_subgroup_files(spark, f"{tmp_path}/one/*.csv").collect())
    assert got == [("scrfd", "scrfd"), ("yolo", "yolo")]
    assert [r["model"] for r in scan_subgroup_files(spark, f"{tmp_path}/two/*.csv").collect()] == ["a=b"]
