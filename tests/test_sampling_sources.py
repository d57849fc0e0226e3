import hashlib
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameops.lineage import scratch
from frameops.operators import joins as J
from frameops.operators import quality as Q
from frameops.operators import sampling as P
from frameops.operators.features import quantile_cues
from frameops.operators.scale import split_hot, top_k
from frameops.operators.windows import pct_dense_rank
from frameops.plans.registry import build_sql, r6
from frameops.sources import scans, sinks
from frameops.sources.sinks import write_atomic


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, f"d{i % 3}/members/p{i % 5}/{i:04d}.webp", f"d{i % 3}", "a" if i % 3 else "b") for i in range(300)]
    return spark.createDataFrame(rows, "image_id bigint, relative_path string, day_id string, kind string").cache()


def test_stratified_sample_is_exact_and_stable(frames):
    a = {r[0] for r in P.stratified_sample(frames, "relative_path", ["kind"], 50).select("image_id").collect()}
    b = {r[0] for r in P.stratified_sample(frames.repartition(5), "relative_path", ["kind"], 50).select("image_id").collect()}
    assert a == b and len(a) == 50
    counts = {r["kind"]: r["count"] for r in P.stratified_sample(frames, "relative_path", ["kind"], 50).groupBy("kind").count().collect()}
    assert counts == {"a": 33, "b": 17}
    with pytest.raises(ValueError):
        P.stratified_sample(frames, "relative_path", ["kind"], 301)


def test_chained_subsets_are_disjoint(frames):
    spec = [{"name": "one", "n": 60, "strata": ["kind"]}, {"name": "two", "n": 70, "strata": ["day_id"]}]
    out = P.chained_subsets(frames, "relative_path", spec)
    assert out.count() == 130 and out.select("relative_path").distinct().count() == 130
    parts = {n: out.filter(F.col("subset") == n) for n in ("one", "two")}
    Q.assert_disjoint(parts, "relative_path")
    with pytest.raises(ValueError):
        Q.assert_disjoint({"one": parts["one"], "again": parts["one"]}, "relative_path")


def lightest_first(sizes, k):
    loads, folds = [0] * k, {}
    for group, n in sorted(sizes.items(), key=lambda item: (-item[1], item[0] is not None, item[0])):
        fold = loads.index(min(loads))
        loads[fold] += n
        folds[group] = fold + 1
    return folds


@pytest.mark.parametrize("limit", [10_000, 2])
def test_group_folds_are_those_of_the_lightest_fold(spark, limit):
    groups = [g for g in [None, *range(40)] for _ in range(1 + (7 * (g or 5)) % 9)] + [99] * 60
    rows = P.group_kfold(spark.createDataFrame([(g,) for g in groups], "g int").repartition(3), "g", 4, limit).collect()
    want = lightest_first({g: groups.count(g) for g in set(groups)}, 4)
    assert len(rows) == len(groups) and all(want[r.g] == r.fold for r in rows)


def test_fold_segments_equal_single_steps():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [(n, rng.randrange(1, 30)) for n in sorted(rng.sample(range(1, 60), rng.randrange(1, 6)), reverse=True)]
        k = rng.randrange(1, 6)
        segments = P.fold_segments(sizes, k)
        got = []
        for size, n in sizes:
            for rank in range(n):
                start, folds = [(r, f) for s, r, f in segments if s == size and r <= rank][-1]
                got.append(folds[(rank - start) % len(folds)])
        ids = [(size, i) for size, n in sizes for i in range(n)]
        assert got == list(lightest_first(dict.fromkeys(ids, 0) | {i: i[0] for i in ids}, k).values())
        assert len(segments) <= len(sizes) * (k + 1)


def test_large_ranks_split_a_hot_stratum(spark):
    rows = spark.range(3000).withColumn("s", F.when(F.col("id") % 3 == 0, "a"))
    got = top_k(rows, ["s"], [F.col("id")], 1500, "r")
    rank = F.row_number().over(Window.partitionBy("s").orderBy("id"))
    want = rows.withColumn("r", rank).filter("r <= 1500")
    assert {(r.id, r.r) for r in got.collect()} == {(r.id, r.r) for r in want.collect()}


def test_atomic_write_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write_atomic(spark.range(5), path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        write_atomic(broken, path)
    assert spark.read.parquet(path).count() == 5
    write_atomic(spark.read.parquet(path).filter("id > 1"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_output_rounding(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 1e15, -3.0e13, 0.1234564, 0.1234565, -2.5, 123456.1234567]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(r6(F.col("v"))).collect()]
    assert str(got) == str([None, float("nan"), float("inf"), float("-inf"), 0.0, 1e15, -3.0e13, 0.123456, 0.123457, -2.5, 123456.123457])
    con = duckdb.connect()
    con.execute("CREATE TABLE t (v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    assert str([r[0] for r in con.execute(build_sql("SELECT v FROM t", dbl="v")).fetchall()]) == str(got)


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 2.0), (None, 3.0)], "k string, v double")
    assert pct_dense_rank(rows, ["k"], "v").count() == 4
    cues = spark.createDataFrame([(None, 1.0, 1.0, 1.0), ("a", None, 2.0, 1.0), ("b", 2.0, 1.0, 3.0)], "p string, sharp double, bright double, dense double")
    assert quantile_cues(cues, "p", "sharp", "bright", "dense").count() == 3
    hot = rows.select("k").distinct().filter("k IS NULL")
    cold, inside = split_hot(rows, ["k"], hot)
    assert cold.count() == 2 and inside.count() == 2


@pytest.mark.parametrize("limit", [10**6, 50])
def test_stratified_folds_are_balanced(frames, limit):
    rows = P.stratified_kfold(frames, "relative_path", "kind", 5, limit=limit)
    assert {r["count"] for r in rows.filter("kind = 'b'").groupBy("fold").count().collect()} == {20}


def test_locked_variants(spark):
    table = spark.createDataFrame([("text", "a", "development", 0.9), ("text", "b", "development", 0.5), ("text", "b", "test", 1.0)], "modality string, variant string, split string, score double")
    assert P.lock_variant(table, "score").first()["variant"] == "a"
    assert P.lock_variant(table, "score", locked="b").first()["variant"] == "b"
    with pytest.raises(ValueError):
        P.lock_variant(table, "score", split="test")


def test_join_validation(spark):
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    many = spark.createDataFrame([(1, 1), (1, 2)], "k int, b int")
    assert J.join_validated(many, one, ["k"], "many_to_one").count() == 2
    with pytest.raises(ValueError):
        J.join_validated(one, many, ["k"], "one_to_one")


def test_inventory_has_checksums(spark, tmp_path):
    folder = tmp_path / "day1" / "members" / "anna"
    folder.mkdir(parents=True)
    (folder / "08_0001.webp").write_bytes(b"abc")
    row = scans.inventory_files(spark, str(tmp_path)).first()
    assert row["relative_path"] == "day1/members/anna/08_0001.webp" and row["file_size_bytes"] == 3
    assert row["checksum_sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert (row["day_id"], row["participant_id"], row["view_type"], row["file_ext"]) == ("day1", "anna", "egocentric", ".webp")


def test_metric_json_and_missing_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"detailed": [{"path": "a", "ssim": 0.5},\n {"path": "b"}]}')
    assert scans.scan_metric_json(spark, str(tmp_path / "m.json"), "path string, ssim double").count() == 2
    empty = scans.scan_metric_json(spark, str(tmp_path / "none.json"), "path string, ssim double")
    assert empty.count() == 0 and empty.columns == ["path", "ssim"]


def test_shards_partition_the_rows(frames):
    for by in ("hash", "index"):
        assert sum(scans.select_shard(frames, i, 4, "relative_path", by).count() for i in range(4)) == 300
    with pytest.raises(ValueError):
        scans.select_shard(frames, 4, 4, "relative_path")


def test_cache_refresh_fails_when_values_stay_missing(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    cache = spark.createDataFrame([(1, 0.5, 1), (1, None, 0)], "k int, v double, version int")
    updated, done = sinks.refresh_cache(cache, rows, "k", ["v"], lambda m: m.withColumn("v", F.lit(9.0)))
    assert {(r["k"], r["v"]) for r in done.collect()} == {(1, 0.5), (2, 9.0)} and updated.count() == 2
    _, broken = sinks.refresh_cache(cache, rows, "k", ["v"], lambda m: m.withColumn("v", F.lit(None).cast("double")))
    with pytest.raises(Exception, match="still missing"):
        broken.collect()


def test_canonical_conflict_fails(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    other = spark.createDataFrame([(1, "b")], "k int, v string")
    out = Q.canonical_override(rows, other, ["k"], "v")
    assert out.first()["v"] == "b"
    with pytest.raises(Exception, match="disagree"):
        Q.require_no_conflict(out).collect()


def test_decision_log_appends(spark):
    path = scratch(spark, "log")
    df = spark.createDataFrame([(1, "balanced")], "image_id int, objective string")
    sinks.decision_log(df, path)
    sinks.decision_log(df, path)
    assert spark.read.parquet(path).count() == 2
