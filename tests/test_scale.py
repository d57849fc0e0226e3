import random

import pytest
from pyspark.sql import functions as F

from frameops.operators import reconstructed as R
from frameops.operators import windows as W
from frameops.operators.scale import exact_quantiles, running_totals, top_k


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", i, float(rnd.randrange(50))) for i in range(400)]
    return spark.createDataFrame(data, "k string, id bigint, v double")


@pytest.mark.parametrize("limit", [10**6, 20], ids=["window", "ranged"])
def test_running_totals(rows, limit):
    out = running_totals(rows, ["k"], [F.col("v"), F.col("id")], {"n": F.lit(1), "s": F.col("v")}, limit).collect()
    assert len(out) == 400
    for k in {r["k"] for r in out}:
        mine = sorted((r for r in out if r["k"] == k), key=lambda r: (r["v"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine[-1]["s"] == pytest.approx(sum(r["v"] for r in mine))


@pytest.mark.parametrize("by", [["k"], []])
def test_quantiles_agree(rows, by):
    probs = {"a": 0.2, "b": 0.5, "c": 0.66}
    small = {tuple(r[k] for k in by): r for r in exact_quantiles(rows, by, "v", probs).collect()}
    large = {tuple(r[k] for k in by): r for r in exact_quantiles(rows, by, "v", probs, limit=5).collect()}
    assert small.keys() == large.keys()
    for key, row in small.items():
        for name in probs:
            assert row[name] == pytest.approx(large[key][name])


def test_top_k_limits_rows_before_the_shuffle(rows):
    df = top_k(rows, ["k"], [F.col("v"), F.col("id")], 3)
    assert df.count() == 3 * rows.select("k").distinct().count()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [10**6, 20], ids=["window", "ranged"])
def test_quantile_labels(rows, limit):
    out = W.quantile_label(rows, "v", "id", limit=limit).groupBy("level").count().collect()
    assert sum(r["count"] for r in out) == 400 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1


@pytest.mark.parametrize("limit", [10**6, 5], ids=["window", "ranged"])
def test_verification_equals_pair_counting(spark, limit):
    rnd = random.Random(9)
    data = [("m", rnd.randrange(30) / 30, i % 2) for i in range(200)]
    row = R.verification_metrics(spark.createDataFrame(data, "method string, similarity double, positive int"), limit=limit).first()
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert row["auc"] == pytest.approx(auc)
