"""Weights of the bootstrap (C02) drawn in pieces, by their upper bits."""

import time

import numpy as np
import pyarrow as pa

from frameops.operators import stats as S


def plain_weights(cases, start, stop):
    z = cases.astype(np.uint64)[:, None] + np.arange(start + 1, stop + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return np.searchsorted(S._poisson_limits(), (z >> np.uint64(11)) / 2.0**53, "right").astype(np.float64)


def test_weights_equal_inversion_draw_by_draw_and_cost_less():
    cases = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 3000)
    took = []
    for fn in (plain_weights, S.poisson_weights):
        times = []
        for _ in range(3):
            start = time.perf_counter()
            got = fn(cases, 500, 1000)
            times.append(time.perf_counter() - start)
        took.append((got, min(times)))
    assert np.array_equal(took[0][0], took[1][0])
    assert took[1][1] < took[0][1] / 2
    assert np.array_equal(S.poisson_weights(cases[:70], 3, 40_003), plain_weights(cases[:70], 3, 40_003))
    assert S.poisson_weights(cases[:0], 0, 10).shape == (0, 10) and S._weight_table().max() == 255


def test_keys_share_one_product():
    rng = np.random.default_rng(6)
    case, key, value = np.repeat(rng.integers(-(2**63), 2**63 - 1, 40), 3), np.tile(["a", "b", None], 40), rng.normal(size=120)
    batch = pa.RecordBatch.from_arrays([pa.array(key.tolist(), pa.string()), pa.array(case), pa.array(value)], names=["k", "__case", "__v"])
    got = pa.Table.from_batches(list(S._resampled_sums(["k"], 700, iter([batch, batch.slice(0, 0)])))).to_pylist()
    for name in ("a", "b", None):
        own = np.array([k == name if name else k is None for k in key.tolist()])
        w = plain_weights(case[own], 0, 700)
        rows = sorted((r for r in got if r["k"] == name), key=lambda r: r["start"])
        assert np.allclose(np.concatenate([r["w"] for r in rows]), w.sum(0))
        assert np.allclose(np.concatenate([r["s"] for r in rows]), value[own] @ w)


def test_draws_are_dealt_to_all_cores(spark):
    """A few bytes of input are much work, so they must not end in one task."""
    df = spark.range(400).selectExpr("'k' AS k", "id AS case", "id * 0.01D AS difference").coalesce(1)
    plan = S.bootstrap_means(df, ["k"], "case", "difference", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__case" in plan and f", {S.TASKS_PER_CORE * spark.sparkContext.defaultParallelism}" in plan
