"""Sinks and incremental maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameops.operators.windows import keep_one


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows under the union of all columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_union(tables: Sequence[DataFrame], path: str) -> None:
    """K01."""
    write_atomic(union_all(tables), path)


def write_atomic(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table. The new rows are complete in a folder beside it before the old ones go.

    A failing job leaves the old table as it is, and ``df`` may read the table it replaces. Between the two renames of the swap
    readers find no table; on a store whose renames copy, use a versioned path instead.
    """
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}__{name}_{uuid.uuid4().hex}" for name in ("new", "old"))
    places = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, old)]
    files = places[0].getFileSystem(spark._jsc.hadoopConfiguration())
    target, source, aside = places
    try:
        df.write.partitionBy(*partition_by).parquet(fresh)
    except Exception:
        files.delete(source, True)
        raise
    had = files.exists(target)
    if had and not files.rename(target, aside):
        raise OSError(f"can't move {path} aside")
    if not files.rename(source, target):
        if had:
            files.rename(aside, target)
        raise OSError(f"can't move {fresh} to {path}")
    files.delete(aside, True)


def decision_log(df: DataFrame, path: str) -> None:
    """Append per-frame routing decisions, one folder per objective."""
    df.write.mode("append").partitionBy("objective").parquet(path)


def refresh_cache(cache: DataFrame, rows: DataFrame, key: str, columns: Sequence[str],
                  compute: Callable[[DataFrame], DataFrame], version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(new cache, completed rows).

    A cached row with a null analysis column counts as missing.  Only missing
    keys are computed; the latest row per key stays; a null left after that
    fails the job.
    """
    latest = keep_one(cache, [key], [F.col(version).desc()])
    complete = latest.dropna(subset=list(columns))
    missing = rows.join(complete.select(key), key, "left_anti")
    newest = cache.agg(F.coalesce(F.max(version), F.lit(0)).alias("__v"))
    fresh = compute(missing).crossJoin(F.broadcast(newest)).withColumn(version, F.col("__v") + 1).drop("__v")
    updated = keep_one(complete.unionByName(fresh, allowMissingColumns=True), [key], [F.col(version).desc()])
    joined = rows.join(updated.select(key, *columns), key, "left")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    checked = joined.filter(F.assert_true(whole, "analysis columns are still missing").isNull())
    return updated, checked


def resume_pairs(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("relative_path", "method")) -> DataFrame:
    """Work that is not completed yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def subgroup_rows(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Each row once per subgroup rule it satisfies."""
    groups = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return df.withColumn("subgroup", F.explode(groups))


def partition_by_subgroup(df: DataFrame, rules: Sequence[tuple[str, Column]], path: str) -> None:
    """One folder per subgroup."""
    write_atomic(subgroup_rows(df, rules), path, ["subgroup"])


def copy_plan(manifests: Sequence[DataFrame], inventory: DataFrame, target: DataFrame, key: str = "relative_path") -> DataFrame:
    """Distinct requested paths with size and status (missing, present or copy)."""
    requested = reduce(DataFrame.unionByName, [m.select(key) for m in manifests]).distinct()
    have = inventory.select(key, F.col("size_bytes").alias("source_bytes"))
    there = target.select(key, F.col("size_bytes").alias("target_bytes"))
    out = requested.join(have, key, "left").join(there, key, "left")
    status = (F.when(F.col("source_bytes").isNull(), "missing")
              .when(F.col("target_bytes") == F.col("source_bytes"), "already_present").otherwise("copy"))
    return out.withColumn("status", status)


def copy_totals(plan: DataFrame) -> DataFrame:
    """K07 totals; GiB and MiB of what is there to copy."""
    size = F.coalesce(F.sum("source_bytes"), F.lit(0))
    return plan.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("status") == "already_present").alias("already_present"), size.alias("bytes"),
        (size / 1024.0 / 1024.0).alias("mib"), (size / 1024.0 / 1024.0 / 1024.0).alias("gib"))


def missing_examples(plan: DataFrame, n: int = 20, key: str = "relative_path") -> DataFrame:
    """The first missing paths of the report."""
    return plan.filter(F.col("status") == "missing").select(key).orderBy(key).limit(n)


def subset_sinks(summary: DataFrame, annotations: DataFrame) -> dict[str, DataFrame]:
    """Zero-face false positives and missed faces, each in review order."""
    joined = summary.join(annotations, "image_id", "left")
    zero = joined.filter(F.col("zero_face_image") & (F.col("false_positive_count") > 0))
    missed = joined.filter(F.col("false_negative_count") > 0)
    return {
        "zero_face_false_positives": zero.orderBy(F.col("false_positive_count").desc(), "image_id"),
        "missed_faces": missed.orderBy(F.col("false_negative_count").desc(), F.col("gt_count").desc(), "image_id"),
    }


def split_by_kind(records: DataFrame) -> DataFrame:
    """Nested records (faces, screens, texts arrays) to box rows with their kind.

    A box without score gets 1.0; sources are joined to one text.
    """
    parts = []
    for kind, column in (("face", "faces"), ("screen", "screens"), ("text", "texts")):
        rows = records.select("image_id", F.array_join("sources", "+").alias("sources"), F.inline(column))
        parts.append(rows.withColumn("kind", F.lit(kind)).withColumn("score", F.coalesce("score", F.lit(1.0))))
    return reduce(DataFrame.unionByName, parts)


def write_by_kind(records: DataFrame, path: str) -> None:
    """One folder per kind."""
    write_atomic(split_by_kind(records), path, ["kind"])


def write_files(df: DataFrame, root: str, path: str, content: str) -> None:
    """One file per row: the text of ``content`` in UTF-8 (null: empty) at ``path`` below ``root``; a repeated task writes the same again."""
    from frameops.sources.scans import open_path

    def run(batches):
        system, base = open_path(root if ":" in root else f"file:{root}")
        made = set()
        for batch in batches:
            for name, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                folder = f"{base}/{name}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{name}") as stream:
                    stream.write((text or "").encode())
            yield batch.slice(0, 0)

    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    rows.mapInArrow(run, rows.schema).write.format("noop").mode("overwrite").save()
