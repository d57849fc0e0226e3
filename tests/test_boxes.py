import random

import pytest
from pyspark.sql import functions as F

from frameops.functions.geometry import iou as iou_column
from frameops.operators import boxes as X
from frameops.operators import matching as M
from tests import brute

PRED = "image_id bigint, pred_id bigint, source string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double"
GT = "image_id bigint, gt_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def random_boxes(seed, images=6, n=25, span=400):
    rnd = random.Random(seed)
    preds, gts = [], []
    for image in range(images):
        for i in range(n):
            x, y, w, h = rnd.randrange(span), rnd.randrange(span), rnd.randrange(30, 120), rnd.randrange(30, 120)
            gts.append((image, image * 1000 + i, x, y, x + w, y + h))
            for s in range(2):
                dx, dy = rnd.randrange(-25, 25), rnd.randrange(-25, 25)
                preds.append((image, (image * 1000 + i) * 2 + s, f"s{s}", x + dx - 40, y + dy, x + dx + w - 40, y + dy + h, rnd.randrange(1, 20) / 20))
    return preds, gts


@pytest.fixture(scope="module")
def data(spark):
    preds, gts = random_boxes(1)
    return spark.createDataFrame(preds, PRED), spark.createDataFrame(gts, GT)


def by_image(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["image_id"], []).append(row.asDict())
    return out


def test_iou_known_value(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    assert df.select(iou_column("a_", "b_")).first()[0] == pytest.approx(25 / 175)


def test_average_precision_of_one_hit_and_one_lower_false_positive(spark):
    pred = spark.createDataFrame([(1, 1, "m", 0, 0, 10, 10, 0.9), (1, 2, "m", 50, 50, 60, 60, 0.3)], PRED)
    gt = spark.createDataFrame([(1, 1, 0, 0, 10, 10)], GT)
    row = M.average_precision(M.match_greedy(pred, gt), gt.agg(F.count("*").alias("ground_truth_boxes"))).first()
    assert (row["ap"], row["precision"], row["recall"]) == (1.0, 0.5, 1.0)


def test_two_equal_predictions_give_a_hit_then_a_miss(spark):
    pred = spark.createDataFrame([(1, 1, "m", 0, 0, 10, 10, 0.9), (1, 2, "m", 0, 0, 10, 10, 0.9)], PRED)
    gt = spark.createDataFrame([(1, 1, 0, 0, 10, 10)], GT)
    flags = {r["pred_id"]: r["true_positive"] for r in M.match_greedy(pred, gt).collect()}
    assert flags == {1: True, 2: False}


def test_no_truth_gives_zeros(spark):
    pred = spark.createDataFrame([(1, 1, "m", 0, 0, 10, 10, 0.9)], PRED)
    gt = spark.createDataFrame([], GT)
    row = M.average_precision(M.match_greedy(pred, gt), gt.agg(F.count("*").alias("ground_truth_boxes"))).first()
    assert (row["ap"], row["recall"], row["f1"], row["false_positives"], row["false_negatives"]) == (0.0, 0.0, 0.0, 1, 0)


@pytest.mark.parametrize("limit", [1000, 1], ids=["folded", "rounds"])
@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_match_equals_brute_force(data, limit, threshold):
    pred, gt = data
    rows = M.match_greedy(pred, gt, threshold, limit=limit).collect()
    assert len(rows) == pred.count()
    preds, gts = by_image(pred), by_image(gt)
    for image, boxes in preds.items():
        want = brute.greedy_match(boxes, gts.get(image, []), threshold)
        got = {r["pred_id"]: (r["gt_id"], r["iou"]) for r in rows if r["image_id"] == image}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        for k, v in want.items():
            assert got[k][1] == pytest.approx(v[1])


def test_match_mixes_hot_and_cold_images(spark, data):
    pred, gt = data
    extra = spark.createDataFrame([(99, 1, "s0", 0, 0, 10, 10, 0.5)], PRED)
    both = pred.unionByName(extra)
    a = {(r["image_id"], r["pred_id"]): r["gt_id"] for r in M.match_greedy(both, gt, limit=60).collect()}
    b = {(r["image_id"], r["pred_id"]): r["gt_id"] for r in M.match_greedy(both, gt).collect()}
    assert a == b and len(a) == both.count()


def test_match_per_source(data):
    pred, gt = data
    rows = M.match_greedy(pred, gt, extra=["source"]).collect()
    alone = M.match_greedy(pred.filter("source = 's1'"), gt).collect()
    assert {r["pred_id"]: r["gt_id"] for r in rows if r["source"] == "s1"} == {r["pred_id"]: r["gt_id"] for r in alone}


@pytest.mark.parametrize("limit", [1000, 1], ids=["folded", "rounds"])
def test_suppression_equals_brute_force(data, limit):
    pred, _ = data
    kept = {r["pred_id"] for r in X.nms(pred, 0.4, limit=limit).collect()}
    want = set()
    for boxes in by_image(pred).values():
        want |= {k for k, v in brute.seeds(boxes, 0.4).items() if k == v}
    assert kept == want


@pytest.mark.parametrize("limit", [1000, 1], ids=["folded", "rounds"])
def test_clusters_equal_brute_force(data, limit):
    pred, _ = data
    got = {(r["image_id"], r["cluster_id"]): r for r in X.cluster_boxes(pred, 0.45, limit=limit).collect()}
    for image, boxes in by_image(pred).items():
        groups = {}
        for pid, seed in brute.seeds(boxes, 0.45).items():
            groups.setdefault(seed, []).append(next(b for b in boxes if b["pred_id"] == pid))
        for seed, members in groups.items():
            row = got[(image, seed)]
            total = sum(m["score"] for m in members)
            assert row["x1"] == round(round(sum(m["x1"] * m["score"] for m in members) / total, 9))
            assert row["members"] == len(members) and set(row["sources"]) == {m["source"] for m in members}
    assert len(got) == sum(len({*brute.seeds(b, 0.45).values()}) for b in by_image(pred).values())


@pytest.mark.parametrize("limit", [1000, 1], ids=["folded", "rounds"])
def test_fallback_keeps_primary_and_adds_only_new_boxes(data, limit):
    pred, _ = data
    first, second = pred.filter("source = 's0'"), pred.filter("source = 's1'")
    out = X.fallback_merge(first, second, first.select("image_id"), 0.5, 0.95, limit=limit).collect()
    assert {r["pred_id"] for r in out if not r["from_fallback"]} == {r["pred_id"] for r in first.collect()}
    for image, boxes in by_image(first).items():
        merged = list(boxes)
        for cand in sorted(by_image(second).get(image, []), key=lambda r: r["pred_id"]):
            if all(brute.iou(cand, b) < 0.5 for b in merged):
                merged.append(cand)
        assert {r["pred_id"] for r in out if r["image_id"] == image} == {b["pred_id"] for b in merged}


def test_ranged_running_sums_equal_the_window(data):
    pred, gt = data
    matches = M.match_greedy(pred, gt, extra=["source"])
    truth = pred.select("source").distinct().crossJoin(gt.agg(F.count("*").alias("ground_truth_boxes")))
    a = {r["source"]: r["ap"] for r in M.average_precision(matches, truth, ["source"]).collect()}
    b = {r["source"]: r["ap"] for r in M.average_precision(matches, truth, ["source"], limit=1).collect()}
    assert a == pytest.approx(b)


def test_linked_components_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for image in range(30):
        for i in range(rnd.randrange(3, 40)):
            x, y = rnd.randrange(900), rnd.randrange(900)
            rows.append((image, i, "t", x, y, x + rnd.randrange(5, 60), y + rnd.randrange(5, 60), 0.5))
    boxes = spark.createDataFrame(rows, PRED)
    frames = spark.createDataFrame([(i, 1000, 1000) for i in range(30)], "image_id bigint, width bigint, height bigint")
    got = sorted((r["image_id"], r["members"]) for r in X.link_components(boxes, frames, min_area=0.0, max_area=1.0).collect())
    want = []
    for image in range(30):
        mine = [((r[3] + r[5]) / 2, (r[4] + r[6]) / 2) for r in rows if r[0] == image]
        if len(mine) >= 5:
            want += [(image, len(g)) for g in brute.components(mine, 0.09 * 1000) if len(g) >= 5]
    assert got == sorted(want)


def test_postfilter_sweep_equals_single_runs(data):
    pred, gt = data
    from frameops.functions.geometry import postfilter_drop

    sweep = {r["grid_id"]: r for r in X.sweep_postfilter(pred, gt, (0, 60), (40,), (0.4, 0.8), 500, 500).collect()}
    for i, (m, t) in enumerate([(0, 0.4), (0, 0.8), (60, 0.4), (60, 0.8)]):
        kept = pred.filter(~postfilter_drop(m, 40, t, 500, 500))
        row = M.average_precision(M.match_greedy(kept, gt), gt.agg(F.count("*").alias("ground_truth_boxes"))).first()
        assert sweep[i]["ap"] == pytest.approx(row["ap"]) and sweep[i]["true_positives"] == row["true_positives"]
        assert sweep[i]["removed_count"] == pred.count() - kept.count()


def test_mcnemar(spark):
    a = spark.createDataFrame([(i, i < 30) for i in range(50)], "image_id bigint, correct boolean")
    b = spark.createDataFrame([(i, i < 15) for i in range(50)], "image_id bigint, correct boolean")
    row = M.mcnemar(a, b).first()
    assert (row["only_first"], row["only_second"]) == (15, 0)
    assert row["chi_square"] == pytest.approx(14 * 14 / 15) and row["p_value"] == pytest.approx(0.000300, abs=2e-6)
