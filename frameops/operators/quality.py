"""Validation, integrity and profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.functions.labels import infer_metadata, is_4k, status_success


def manifest_issues(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per (file, issue).

    ``manifest``: relative_path, image_width, image_height, checksum_sha256, read_status.
    ``inventory``: relative_path, actual_width, actual_height, actual_checksum, open_ok.
    """
    c = F.col
    joined = manifest.join(inventory.withColumn("__found", F.lit(True)), "relative_path", "left")
    found, opened = c("__found").isNotNull(), F.coalesce(c("open_ok"), F.lit(False))
    same_size = F.coalesce((c("actual_width") == c("image_width")) & (c("actual_height") == c("image_height")), F.lit(False))
    checks = [
        ("missing_file", ~found),
        ("checksum_mismatch", found & ~F.coalesce(c("actual_checksum") == c("checksum_sha256"), F.lit(False))),
        ("failed_open", found & ~opened),
        ("dimension_mismatch", opened & ~same_size),
        ("unexpected_dimensions", opened & ~is_4k(c("actual_width"), c("actual_height"))),
        ("manifest_ok_but_failed_validation", found & (c("read_status") == "ok") & ~opened),
    ]
    issues = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return joined.select("relative_path", F.explode(issues).alias("issue"))


def manifest_counts(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """V01 totals: counts by issue and resolution, size statistics and 4K share, as (section, key, value)."""
    issues = manifest_issues(manifest, inventory).groupBy("issue").agg(F.count(F.lit(1)).cast("double").alias("value"))
    resolution = F.concat_ws("x", "actual_width", "actual_height")
    by_size = inventory.groupBy(resolution.alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    stats = manifest.agg(F.avg("file_size_bytes").alias("mean"), F.min("file_size_bytes").cast("double").alias("min"),
                         F.max("file_size_bytes").cast("double").alias("max"))
    share = inventory.agg(F.avg(is_4k(F.col("actual_width"), F.col("actual_height")).cast("double")).alias("value"))
    parts = [
        issues.select(F.lit("issue").alias("section"), F.col("issue").alias("key"), "value"),
        by_size.select(F.lit("resolution").alias("section"), "key", "value"),
        stats.unpivot([], ["mean", "min", "max"], "key", "value").select(F.lit("size").alias("section"), "key", "value"),
        share.select(F.lit("native_4k").alias("section"), F.lit("share").alias("key"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def profile_manifest(manifest: DataFrame) -> DataFrame:
    """Every breakdown of the manifest from one pass over it (grouping sets)."""
    dims = ["camera_stream_id", "view_type", "participant_id", "day_id", "resolution"]
    unknown = {d: F.coalesce(F.nullif(F.col(d), F.lit("null")), F.lit("unknown")) for d in dims[:-1]}
    rows = manifest.withColumns(unknown).withColumn("resolution", F.concat_ws("x", "width", "height"))
    rows = rows.select(*dims, "size_bytes", "integrity_status")
    sets = [[F.col(d)] for d in dims] + [[]]
    out = rows.groupingSets(sets, *dims).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("integrity_status") == "valid").alias("valid_frames"),
        F.sum(F.col("size_bytes") / (1024.0 * 1024.0)).alias("storage_mb"), F.avg("size_bytes").alias("mean_size"),
        F.min("size_bytes").alias("min_size"), F.max("size_bytes").alias("max_size"))
    full = 2 ** len(dims) - 1
    dimension = F
    for i, d in enumerate(dims):
        dimension = dimension.when(F.col("gid") == full - 2 ** (len(dims) - 1 - i), F.lit(d))
    return out.select(dimension.otherwise(F.lit("total")).alias("dimension"), F.coalesce(*dims, F.lit("all")).alias("value"),
                      "frames", "valid_frames", "storage_mb", "mean_size", "min_size", "max_size")


def check_expected_counts(profile: DataFrame, expected: Sequence[tuple[str, int, str]]) -> DataFrame:
    """Observed number of values (or frames) per dimension against (dimension, expected, rule).

    Rule "exact" fails on any difference, "near" warns beyond 5 %.
    """
    spark = profile.sparkSession
    table = spark.createDataFrame(list(expected), "dimension string, expected bigint, rule string")
    observed = profile.groupBy("dimension").agg(
        F.count_if(F.col("value") != "unknown").alias("values"), F.sum("frames").alias("frames"))
    observed = observed.select("dimension", F.when(F.col("dimension") == "total", F.col("frames"))
                               .otherwise(F.col("values")).alias("observed"))
    out = F.broadcast(table).join(observed, "dimension", "left").fillna(0, ["observed"])
    off = F.abs(F.col("observed") - F.col("expected"))
    near = F.when(F.col("expected") == 0, F.col("observed") == 0).otherwise(
        F.try_divide(off, F.col("expected")) <= 0.05)
    status = F.when(F.col("rule") == "exact", F.when(off == 0, "PASS").otherwise("FAIL")).otherwise(
        F.when(near, "PASS").otherwise("WARN"))
    return out.withColumn("status", status)


def clean_path(path: Column, prefix: str = "data/raw/") -> Column:
    """Forward slashes, without the storage prefix."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(slashed.startswith(prefix), F.substr(slashed, F.lit(len(prefix) + 1))).otherwise(slashed)


def verify_locked(manifests: Mapping[str, tuple[DataFrame, int]], index: DataFrame, prefix: str = "data/raw/") -> DataFrame:
    """Rows, unique paths, expected rows and paths missing from the index, per manifest."""
    parts = []
    for name, (df, expected) in manifests.items():
        column = next((c for c in ("relative_path", "image_id", "image_path") if c in df.columns), None)
        if column is None:
            raise KeyError(f"no path column in {df.columns}")
        parts.append(df.select(F.lit(name).alias("manifest"), F.lit(expected).alias("expected"),
                               clean_path(F.col(column).cast("string"), prefix).alias("path")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("manifest", "expected", "path").agg(F.count(F.lit(1)).alias("n"))
    known = index.select(F.col("relative_path").alias("path"), F.lit(1).alias("known")).distinct()
    out = rows.join(known, "path", "left").groupBy("manifest", "expected").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_paths"),
        F.count_if(F.col("known").isNull()).alias("missing_from_index"))
    good = (F.col("rows") == F.col("expected")) & (F.col("unique_paths") == F.col("expected")) & (F.col("missing_from_index") == 0)
    return out.withColumn("ok", good)


def box_issues(boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """First failing rule per box, null when the box is good.

    ``boxes`` has text coordinates; ``frames`` has image_id, width, height (null when the file is missing).
    """
    c = F.col
    known = frames.select("image_id", "width", "height", F.lit(True).alias("__known"))
    out = boxes.join(known, "image_id", "left")
    x1, y1, x2, y2 = (F.expr(f"try_cast({k} AS bigint)") for k in ("x1", "y1", "x2", "y2"))
    whole = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    inside = (x1 >= 0) & (x1 < x2) & (x2 <= c("width")) & (y1 >= 0) & (y1 < y2) & (y2 <= c("height"))
    issue = (F.when(c("__known").isNull(), "unknown_image").when(c("width").isNull(), "missing_image")
             .when(~whole, "non_integer_coordinate").when(~inside, "out_of_bounds"))
    return out.withColumn("issue", issue).drop("__known", "width", "height")


def box_issue_counts(checked: DataFrame) -> DataFrame:
    """V06 totals per issue (null issue = valid boxes)."""
    return checked.groupBy(F.coalesce("issue", F.lit("valid")).alias("issue")).agg(
        F.count(F.lit(1)).alias("boxes"), F.count_distinct("image_id").alias("images"))


def check_header(columns: Sequence[str], required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, list[str]]:
    """Required columns that are absent and columns nobody asked for, at plan time."""
    return {"missing": [c for c in required if c not in columns],
            "unexpected": [c for c in columns if c not in required and c not in optional]}


def overlapping_owners(subsets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys owned by two or more subsets, with the first and last owner."""
    tagged = reduce(DataFrame.unionByName, [df.select(key, F.lit(n).alias("owner")) for n, df in subsets.items()])
    out = tagged.groupBy(key).agg(F.min("owner").alias("first_owner"), F.max("owner").alias("last_owner"))
    return out.filter(F.col("first_owner") != F.col("last_owner"))


def assert_disjoint(subsets: Mapping[str, DataFrame], key: str) -> None:
    """Raises on the first shared key."""
    clash = overlapping_owners(subsets, key).take(1)
    if clash:
        row = clash[0]
        raise ValueError(f"{row[key]} is in both {row['first_owner']} and {row['last_owner']}")


def short_conditions(df: DataFrame, column: str, labels: Sequence[str], minimum: int = 30) -> DataFrame:
    """Labels with fewer than ``minimum`` rows (labels without any row included)."""
    table = df.sparkSession.createDataFrame([(v,) for v in labels], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(table).join(counts, column, "left").fillna(0, ["rows"]).filter(F.col("rows") < minimum)


def levels_per_dimension(df: DataFrame, dims: Sequence[str], minimum: int = 3) -> DataFrame:
    """Distinct values per dimension and whether they reach the minimum."""
    counts = df.agg(*[F.count_distinct(d).alias(d) for d in dims])
    out = counts.unpivot([], list(dims), "dimension", "levels")
    return out.withColumn("ok", F.col("levels") >= minimum)


def repair_metadata(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """Empty, nan or null metadata replaced by the values in the path."""
    derived = infer_metadata(F.col(path))

    def missing(column: Column) -> Column:
        return column.isNull() | F.lower(F.trim(column)).isin("", "nan", "null")

    return df.withColumns({
        name: F.when(missing(F.col(name).cast("string")), value).otherwise(F.col(name)) if name in df.columns else value
        for name, value in derived.items()})


def ensure_columns(df: DataFrame, numeric: Sequence[str] = (), boolean: Sequence[str] = (), text: Sequence[str] = (),
                   arrays: Sequence[str] = ()) -> DataFrame:
    """Missing columns with typed defaults."""
    defaults = {**{c: F.lit(0.0) for c in numeric}, **{c: F.lit(False) for c in boolean}, **{c: F.lit("") for c in text},
                **{c: F.array().cast("array<string>") for c in arrays}}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def relabel(df: DataFrame, maps: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Legacy category values to current ones."""
    for column, mapping in maps.items():
        if column in df.columns:
            df = df.replace(dict(mapping), subset=[column])
    return df


def metric_readiness(metrics: DataFrame, quality_limited: Sequence[str] = ("styleid_stylegan", "fams"),
                     frames: int = 500, outputs: int = 450) -> DataFrame:
    """Per-method row counts and readiness class by ordered rules."""
    c = F.col
    out = metrics.groupBy("method").agg(
        F.count(F.lit(1)).alias("manifest_rows"), F.count_if(status_success(c("status"))).alias("success_rows"),
        F.count("ssim").alias("perceptual_rows"), F.count("reid_a").alias("reid_rows"),
        F.count("runtime_seconds").alias("runtime_rows"))
    ready = (c("perceptual_rows") >= frames) & (c("reid_rows") > 0) & (c("runtime_rows") >= outputs)
    status = (F.when(c("method").isin(*quality_limited), "not_policy_ready_quality_limited")
              .when(c("success_rows") < frames, "bounded_policy_candidate_partial_success")
              .when(ready, "policy_ready_per_image_metrics")
              .when(c("manifest_rows") >= outputs, "local_metric_recompute_needed").otherwise("not_ready_missing_outputs"))
    return out.withColumn("readiness_status", status)


def category_coverage(conditions: DataFrame, metrics: DataFrame, labels: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """Rows per category and method with a ready flag; categories without any output stay in."""
    c = F.col
    long = conditions.select("image_id", F.explode(F.array_compact(F.array(
        *[F.when(c(k) == 1, F.lit(k)) for k in labels]))).alias("category"))
    support = long.groupBy("category").agg(F.count(F.lit(1)).alias("support_count"))
    counts = long.join(metrics, "image_id").groupBy("category", "method").agg(
        F.count(F.lit(1)).alias("output_rows"), F.count_if(status_success(c("status"))).alias("success_rows"),
        F.count("ssim").alias("perceptual_rows"), F.count("reid_a").alias("reid_rows"), F.count("runtime_seconds").alias("runtime_rows"))
    every = support.select("*", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    out = every.join(counts, ["category", "method"], "left").fillna(0)
    ready = ((c("perceptual_rows") == c("support_count")) & ((c("reid_rows") > 0) | (c("category") == "no_face"))
             & (c("runtime_rows") > 0))
    return out.withColumn("category_policy_ready", ready)


def canonical_override(rows: DataFrame, canonical: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """The canonical table's value replaces the field; ``conflict`` marks rows where both exist and differ."""
    side = canonical.select(*keys, F.col(field).alias("__canonical"))
    out = rows.join(side, list(keys), "left")
    conflict = F.coalesce(F.col("__canonical") != F.col(field), F.lit(False))
    return out.withColumn("conflict", conflict).withColumn(field, F.coalesce("__canonical", field)).drop("__canonical")


def require_no_conflict(rows: DataFrame, message: str = "sources disagree") -> DataFrame:
    """V16 strict form: fails the job on the first conflicting row."""
    check = F.assert_true(~F.col("conflict"), message)
    return rows.filter(check.isNull()).drop("conflict")


def no_action_safety(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Frames routed to no action must have no candidate box and no predicted face."""
    counts = candidates.groupBy("image_id").agg(F.count(F.lit(1)).alias("candidate_boxes"))
    out = routes.filter(F.col("route") == "no_action_copy").join(counts, "image_id", "left").fillna(0, ["candidate_boxes"])
    safe = (F.col("candidate_boxes") == 0) & (F.col("predicted_no_face") == 1)
    return out.withColumn("verdict", F.when(safe, "SAFE").otherwise("UNSAFE"))


def traceability_check(links: DataFrame, files: DataFrame) -> DataFrame:
    """table/source pairs with existence flags."""
    known = files.select("path").distinct()
    out = links
    for side in ("table_path", "source_path"):
        found = known.select(F.col("path").alias(side), F.lit(True).alias(f"{side}_exists"))
        out = out.join(found, side, "left").fillna(False, [f"{side}_exists"])
    return out.withColumn("status", F.when(F.col("table_path_exists") & F.col("source_path_exists"), "traced").otherwise("broken"))


def contract_check(df: DataFrame, contract: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per contract field, whether it is present and how many rows miss it, in one pass."""
    fields = [(name, f) for name, group in contract.items() for f in group]
    counts = [(F.count_if(F.col(f).isNull()) if f in df.columns else F.count(F.lit(1))).alias(f"{n}.{f}") for n, f in fields]
    totals = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(n).alias("contract"), F.lit(f).alias("field"), F.lit(f in df.columns).alias("present"),
                              F.col(f"`{n}.{f}`").alias("missing_rows")) for n, f in fields])
    return totals.select(F.inline(rows)).withColumn("ok", F.col("present") & (F.col("missing_rows") == 0))
