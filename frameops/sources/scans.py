"""Sources and scans."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.functions.geometry import has_area
from frameops.functions.labels import infer_metadata, stable_order
from frameops.lineage import cut
from frameops.operators.scale import running_totals

MANIFEST_SCHEMA = (
    "relative_path string, file_name string, file_ext string, file_size_bytes bigint, checksum_sha256 string, "
    "image_width bigint, image_height bigint, camera_stream_id string, view_type string, participant_id string, "
    "day_or_session_id string, read_status string, integrity_status string"
)
BOX_SCHEMAS = {
    "gt": "image_id string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, annotator_id string, annotation_round string, "
          "condition_label string, notes string",
    "pred": "image_id string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double, detector_name string",
}
#: Bytes of a file that are in memory at a time.
CHUNK_BYTES = 8_000_000
#: Tasks per core at most that list and hash files.
TASKS_PER_CORE = 8
BOX_JSON = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Valid manifest rows with day_id and timestamp_id."""
    rows = spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True, nullValue="null")
    return rows.filter(F.col("integrity_status") == "valid").withColumns({
        "day_id": F.col("day_or_session_id"),
        "timestamp_id": F.regexp_replace("file_name", r"\.[^.]*$", "")})


def scan_filtered(manifest: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """AND of equality filters; integrity_status = valid unless given."""
    wanted = {"integrity_status": "valid", **filters}
    for column, value in wanted.items():
        if value is not None:
            manifest = manifest.filter(F.col(column) == F.lit(value))
    return manifest


def open_path(path: str):
    """File system and path of a URI as Spark writes it (file:/a or scheme://host/a)."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _with_checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the SHA-256 of the file at ``path``, read in chunks; a file that cannot be opened has none."""
    for batch in batches:
        sums = []
        for path in batch["path"].to_pylist():
            digest = hashlib.sha256()
            try:
                system, name = open_path(path)
                with system.open_input_stream(name) as stream:
                    while chunk := stream.read(CHUNK_BYTES):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            except FileNotFoundError:
                sums.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=[*batch.schema.names, "checksum_sha256"])


def _folder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders in each folder at ``path``, with the size of files; names that Spark takes for its own are left out."""
    for batch in batches:
        for path in batch["path"].to_pylist():
            system, name = open_path(path)
            found = [f for f in system.get_file_info(fs.FileSelector(name)) if not f.base_name.startswith((".", "_"))]
            sizes = [f.size if f.type == fs.FileType.File else None for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{f.base_name}" for f in found], pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and length of every file below ``root``, level by level. Spark's own sources leave empty files out."""
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    folders, levels = [root.rstrip("/")], []
    while folders:
        rows = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), tasks))
        found = cut(rows.mapInArrow(_folder, "path string, length long"))
        levels.append(found.filter("length IS NOT NULL"))
        folders = [row["path"] for row in found.filter("length IS NULL").collect()]
    return reduce(DataFrame.unionByName, levels)


def inventory_files(spark: SparkSession, root: str, checksum: bool = True, glob: str = "*", skip: int = 0) -> DataFrame:
    """Path, name, extension, size and (on request) SHA-256 of every file below ``root``, of no bytes too.

    Files are listed by folder and dealt to tasks; contents never become rows, so a file may be of any size. ``glob`` is for names;
    the first ``skip`` folders below the root are no part of the relative path.
    """
    name = F.split_part(F.col("path"), F.lit("/"), F.lit(-1))
    files = list_files(spark, root)
    if glob != "*":
        files = files.filter(name.rlike(fnmatch.translate(glob)))
    files = files.repartition(max(1, min(files.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    if checksum:
        files = files.mapInArrow(_with_checksum, "path string, length bigint, checksum_sha256 string")
    tail = F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    if skip:
        tail = F.regexp_replace(tail, f"^(?:[^/]*/){{{skip}}}", "")
    out = files.select(
        tail.alias("relative_path"), name.alias("file_name"), F.lower(F.concat(F.lit("."), F.split_part(name, F.lit("."), F.lit(-1)))).alias("file_ext"),
        F.col("length").alias("file_size_bytes"), *(["checksum_sha256"] if checksum else []))
    return out.withColumns(infer_metadata(F.col("relative_path")))


def scan_boxes(spark: SparkSession, path: str, kind: str = "pred") -> DataFrame:
    """Typed truth or prediction boxes from CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(BOX_SCHEMAS[kind]).csv(path, header=True)


def permissive_boxes(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of untyped box tables.

    The key falls back from image_id to relative_path, coordinates are truncated
    to whole pixels and malformed rows are dropped.
    """
    columns = ["image_id", "relative_path", "x1", "y1", "x2", "y2", "score", "detector_name", "condition_label"]
    parts = []
    for df in tables:
        missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
        parts.append(df.withColumns(missing).select(*[F.col(c).cast("string") for c in columns]))
    rows = reduce(DataFrame.unionByName, parts)
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    out = rows.select(
        F.coalesce(F.nullif("image_id", F.lit("")), F.nullif("relative_path", F.lit(""))).alias("image_id"),
        *[F.expr(f"try_cast(try_cast({c} AS double) AS bigint)").alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.coalesce(number("score"), F.lit(1.0)).alias("score"), "detector_name", "condition_label")
    return out.dropna(subset=["image_id", "x1", "y1", "x2", "y2"])


def boxes_per_image(boxes: DataFrame) -> DataFrame:
    """S05 summary: box count, score range and sorted distinct detectors and labels per image."""
    return boxes.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("box_count"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.sort_array(F.collect_set("detector_name")).alias("detectors"),
        F.sort_array(F.collect_set("condition_label")).alias("labels"))


def scan_boxes_permissive(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """S05 from CSV files, all columns read as text."""
    return permissive_boxes([spark.read.csv(p, header=True) for p in paths])


def explode_boxes_json(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """JSON box column to rows; bad JSON gives none; ``strict`` drops boxes without area."""
    boxes = F.from_json(column, BOX_JSON)
    keep = [c for c in df.columns if c != column]
    out = df.select(*keep, F.inline(F.coalesce(boxes, F.array().cast(BOX_JSON))))
    out = out.dropna(subset=["x1", "y1", "x2", "y2"])
    return out.filter(has_area()) if strict else out


def scan_metric_json(spark: SparkSession, path: str, element: str, per_line: bool = False) -> DataFrame:
    """Rows below "detailed" of JSON documents; no file gives an empty typed table.

    A file is one document and so one task; with ``per_line`` each line is one, and files are split.
    """
    try:
        documents = spark.read.schema(f"detailed array<struct<{element}>>").json(path, multiLine=not per_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"struct<{element}>")
    return documents.select(F.inline("detailed"))


def scan_jobs_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One job per JSON line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def select_shard(df: DataFrame, index: int, shards: int, key: str, by: str = "hash", seed: int = 42) -> DataFrame:
    """Shard ``index`` of ``shards``; by hash of the key, or by row position in key order."""
    if not 0 <= index < shards:
        raise ValueError(f"shard {index} is outside 0..{shards - 1}")
    if by == "index":
        placed = running_totals(df, [], [F.col(key)], {"__row": F.lit(1)})
        return placed.filter(F.pmod(F.col("__row") - 1, F.lit(shards)) == index).drop("__row")
    number = F.conv(F.substring(stable_order(seed, F.col(key)), 1, 8), 16, 10).cast("bigint")
    return df.filter(F.pmod(number, F.lit(shards)) == index)


def scan_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Profile, tier and weight tables of a policy registry document (a few rows each)."""
    doc = spark.read.text(path, wholetext=True)
    schema = ("struct<profiles:map<string,map<string,string>>,tiers:map<string,struct<min_vram_mb:bigint,requires_cuda:boolean,"
              "estimated_seconds_per_image:double>>,weights:map<string,map<string,double>>>")
    parsed = doc.select(F.from_json("value", schema).alias("r"))
    return {
        "profiles": parsed.select(F.explode("r.profiles").alias("focus", "p")).select(
            "focus", *[F.col("p")[k].alias(k) for k in ("objective_id", "face_operator", "screen_operator", "text_operator")]),
        "tiers": parsed.select(F.explode("r.tiers").alias("tier", "t")).select("tier", "t.*"),
        "weights": parsed.select(F.explode("r.weights").alias("score", "w")).select("score", F.explode("w").alias("column", "weight")),
    }


def scan_subgroup_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Prediction files read together; the model is the name of the file (or dataset folder, also one of Spark's ``model=``)."""
    rows = spark.read.schema(BOX_SCHEMAS["pred"]).csv(pattern, header=True)
    return rows.withColumn("model", F.regexp_extract(F.input_file_name(), r"(?:/model=|/)([^/]+)\.csv(?:/[^/]*)?$", 1))


def load_image_features(df: DataFrame, protocols: Mapping[str, str]) -> DataFrame:
    """Four quality features keyed by protocol::image."""
    names = F.create_map(*[F.lit(x) for pair in protocols.items() for x in pair])
    protocol = F.coalesce(F.try_element_at(names, F.col("protocol")), F.col("protocol"))
    return df.select(F.concat_ws("::", protocol, F.col("image_id").cast("string")).alias("scoped_id"),
                     *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("brightness", "sharpness", "edge_density", "saturation")])


def load_scene_predictions(df: DataFrame, method: str) -> DataFrame:
    """One method's predictions without the pred_ prefix, keyed by protocol::image."""
    flags = [c for c in df.columns if c.startswith("pred_")]
    return df.filter(F.col("method") == method).select(
        F.concat_ws("::", "protocol", F.col("image_id").cast("string")).alias("scoped_id"),
        *[F.col(c).cast("bigint").alias(c.removeprefix("pred_")) for c in flags])


def split_scoped_id(df: DataFrame) -> DataFrame:
    """Protocol and path of a scoped id, score at eight places, source from the detector name."""
    parts = F.split("scoped_id", "::", 2)
    source = F.coalesce("source", "detector_name") if "source" in df.columns else F.col("detector_name")
    return df.withColumns({"protocol": parts[0], "relative_path": parts[1], "score": F.round("score", 8), "source": source})
