import numpy as np
import pytest
from pyspark.sql import functions as F

from frameops.operators import stats as S
from frameops.operators import vectors as V

EMB = "id bigint, identity bigint, embedding array<double>"


def frame(spark, matrix, identity=None):
    who = identity if identity is not None else range(len(matrix))
    return spark.createDataFrame([(i, int(w), [float(x) for x in row]) for i, (w, row) in enumerate(zip(who, matrix))], EMB)


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    gallery, noise = rng.normal(size=(60, 8)), rng.normal(size=(60, 8))
    query = gallery + 0.8 * noise
    rows = {r["id"]: r for r in V.nearest(frame(spark, query), frame(spark, gallery), block, 5).collect()}
    g = gallery / np.linalg.norm(gallery, axis=1, keepdims=True)
    q = query / np.linalg.norm(query, axis=1, keepdims=True)
    sims = q @ g.T
    for i in range(60):
        assert rows[i]["best_id"] == sims[i].argmax() and rows[i]["similarity"] == pytest.approx(sims[i].max(), abs=1e-9)


def test_nearest_searches_few_cells_at_ten_times_the_rows(spark, monkeypatch):
    """Exact on clustered vectors; cells searched per query do not grow with the gallery."""
    visits, meet = [], V._meet
    monkeypatch.setattr(V, "_meet", lambda wanted, gallery, block: visits.append(wanted.count()) or meet(wanted, gallery, block))
    shares = []
    for n in (1000, 10_000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 20, 16))
        gallery = np.repeat(centres, 20, 0) + 0.02 * rng.normal(size=(n, 16))
        query = gallery[::10] + 0.02 * rng.normal(size=(n // 10, 16))
        visits.clear()
        rows = {r["id"]: r for r in V.nearest(frame(spark, query, list(range(-1, -1 - len(query), -1))), frame(spark, gallery), 512).collect()}
        g, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (gallery, query))
        best = (q @ g.T).argmax(1)
        assert all(rows[i]["best_id"] == best[i] for i in range(len(query)))
        shares.append(sum(visits) / len(query))
    assert shares[1] < 2 * shares[0] + 1


def test_nearest_takes_the_lowest_id_on_ties(spark):
    gallery = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    row = V.nearest(frame(spark, np.array([[2.0, 0.0]]), [99]), frame(spark, gallery)).first()
    assert (row["best_id"], row["similarity"]) == (0, 1.0)


def test_perfect_and_empty_matches(spark):
    m = np.eye(4)
    assert V.reid_rate(V.reid_rank1(frame(spark, m), frame(spark, m))).first()["rank1_rate"] == 1.0
    empty = spark.createDataFrame([], EMB)
    assert V.max_similarity(frame(spark, m), empty).agg(F.max("similarity")).first()[0] == 0.0


def test_frechet(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(80, 3)), rng.normal(1.0, 2.0, size=(90, 3))
    da, db = frame(spark, a), frame(spark, b)
    value = lambda x, y: V.frechet(x, y).first()["frechet_distance"]
    assert value(da, da) == pytest.approx(0.0, abs=1e-8)
    assert value(da, db) == pytest.approx(value(db, da))
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    root = np.sqrt(np.linalg.eigvals(s1 @ s2).real).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * root
    assert value(da, db) == pytest.approx(want)


def test_procrustes_equals_the_svd_form(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(5):
        a, b = rng.normal(size=(9, 2)), rng.normal(size=(9, 2))
        rows += [(k, *map(float, (*p, *q))) for p, q in zip(a, b)]

        def norm(x):
            x = x - x.mean(0)
            return x / np.sqrt((x**2).sum(1).mean())

        u, _, vt = np.linalg.svd(norm(b).T @ norm(a))
        want[k] = np.sqrt(((norm(a) - norm(b) @ (u @ vt)) ** 2).sum(1).mean())
    df = spark.createDataFrame(rows, "id bigint, ax double, ay double, bx double, by double")
    for r in V.procrustes_error(df).collect():
        assert r["procrustes_error"] == pytest.approx(want[r["id"]], abs=1e-7)


def test_text_similarity_rules(spark):
    df = spark.createDataFrame([("", " "), ("abc", ""), ("abcd", "abcd"), ("abcd", "bcde")], "before string, after string")
    for method, last in (("ratio", 0.75), ("levenshtein", 0.5)):
        assert [r["similarity"] for r in V.region_similarity(df, method).collect()] == [1.0, 0.0, 1.0, last]


def test_student_tail_and_critical_value():
    assert S.student_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert S.student_critical(10) == pytest.approx(2.2281389, abs=1e-6)


def test_paired_ttest_interval(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 3.5), (4.0, None), (5.0, 4.0)], "a double, b double")
    row = S.paired_ttest(df).first()
    d = np.array([0.5, 1.0, -0.5, 1.0])
    error = d.std(ddof=1) / 2
    assert row["n"] == 4 and row["t"] == pytest.approx(d.mean() / error)
    assert row["ci_high"] - row["ci_low"] == pytest.approx(2 * 3.1824463 * error, rel=1e-6)


def test_bootstrap_interval_is_close_to_the_normal_one(spark):
    rng = np.random.default_rng(8)
    d = rng.normal(0.3, 1.0, 400)
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(d)], "k string, case bigint, difference double")
    row = S.paired_bootstrap(df, ["k"], "case", "difference", resamples=600).first()
    again = S.paired_bootstrap(df.repartition(7), ["k"], "case", "difference", resamples=600).first()
    half = 1.96 * d.std() / 20
    assert row["mean_difference"] == pytest.approx(d.mean())
    assert row["ci_low"] == pytest.approx(d.mean() - half, abs=0.025) and row["ci_high"] == pytest.approx(d.mean() + half, abs=0.025)
    assert (row["ci_low"], row["ci_high"]) == pytest.approx((again["ci_low"], again["ci_high"]))


@pytest.mark.parametrize("block,cells", [(500, 2_000_000), (7, 70)])
def test_bootstrap_equals_plain_sums(spark, monkeypatch, block, cells):
    """Null keys are keys, null differences are left out, and blocks change nothing."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i // 2, None if i % 11 == 0 else float(x)) for i, x in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame(rows, "k string, case bigint, difference double").repartition(4)
    whole = S._resampled_sums

    def small(keys, resamples, batches):
        S.RESAMPLE_BLOCK, S.WEIGHT_CELLS = block, cells
        yield from whole(keys, resamples, batches)

    monkeypatch.setattr(S, "_resampled_sums", small)
    got = {(r["k"], r["resample"]): r["mean"] for r in S.bootstrap_means(df, ["k"], "case", "difference", 30).collect()}
    hashes = {r["case"]: r["h"] for r in df.select("case", F.xxhash64(F.lit(20260712), "case").alias("h")).distinct().collect()}
    weights = {c: S.poisson_weights(np.array([h]), 0, 30)[0] for c, h in hashes.items()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [(weights[c], d) for name, c, d in rows if name == k and d is not None]
        want |= {(k, r): sum(w[r] * d for w, d in own) / sum(w[r] for w, _ in own) for r in range(30)}
    assert got == pytest.approx(want)


def test_poisson_weights():
    w = S.poisson_weights(np.arange(1000), 0, 1000)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.003)
