"""Intermediate tables in the cluster's shared folder, and connected components over links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.llm.rows import small_batches

#: Links that one task may hold.
TASK_LINKS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Parquet tables of one operator run under a folder of their own in the shared folder.

    Written tables cut the lineage and survive lost executors. ``drop`` removes a table as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(kept)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node of each one's component, by hooking and pointer jumping on arrays."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[low], parent[high]
        apart = x != y
        if not apart.any():
            return nodes, nodes[parent]
        low, high = low[apart], high[apart]
        np.minimum.at(parent, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars around smallest nodes."""
    parts = [(batch["v"].to_numpy(), batch["m"].to_numpy()) for batch in batches]
    if parts:
        nodes, low = smallest_reachable(*map(np.concatenate, zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low)], names=["v", "m"])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), both long: rows (node, component), the component being its smallest node.

    Nodes without links do not appear. Links are first contracted within each task. While more than ``TASK_LINKS`` are left,
    large-star and small-star steps alternate: they keep components and turn each into a star around its smallest node in a
    number of rounds that grows with the logarithm of its size. Minima are pre-aggregated there, and adaptive execution splits
    the join of a hub. What fits into one task by a count of its rows is contracted there.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v > m")
    edges = scratch.keep(edges.mapInArrow(_contract, "v long, m long").where("v > m"), "links")
    seen = None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if size[0] <= TASK_LINKS:
            return edges.coalesce(1).mapInArrow(_contract, "node long, component long")
        if seen == tuple(size):
            break
        seen = tuple(size)
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("n")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("n")))
        lowest = both.groupBy("u").agg(F.min("n").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lowest, "u").where("n > u").select(F.col("n").alias("v"), F.col("low").alias("m")).distinct()
        # small star: every node points to the smallest of its smaller neighbours, and so do those neighbours
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        pairs = F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))
        after = scratch.keep(large.join(least, "v").select(F.explode(pairs).alias("e")).select("e.v", "e.m").where("v > m").distinct(), "links")
        scratch.drop(edges)
        edges = after
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).union(edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
