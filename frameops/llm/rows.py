"""Adding computed columns to every row in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, unless the session has a number of its own: a row may hold a long text or set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def add_columns(docs: DataFrame, added: str, compute: Callable[[pa.RecordBatch], dict[str, list]], start: Callable[[], None] | None = None) -> DataFrame:
    """All columns of ``docs`` plus the columns ``added`` (a DDL schema) that ``compute`` returns for a batch.

    An input column with the name of an added one gives way to it. Rows keep their partition; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    kept = [f for f in docs.schema if f.name.lower() not in names]
    kinds = [to_arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start is not None:
            start()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = compute(batch)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(made[f.name], kind) for f, kind in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [f.name for f in new])

    return docs.mapInArrow(run, T.StructType(kept + [T.StructField(f.name, f.dataType, True) for f in new]))


def hash_sample(docs: DataFrame, wanted: int, salt: int, among: Column | None = None) -> DataFrame:
    """About ``wanted`` rows of ``docs``, never more than twice as many, picked by a hash of doc_id; of these, the rows ``among``.

    The threshold on the hash keeps what the tasks send small; the limit only matters where one id has many rows.
    """
    order = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30))
    share = wanted / max(1, docs.count())
    picked = docs.where(order < share * (1 << 30))
    return (picked if among is None else picked.where(among)).orderBy(order, "doc_id").limit(2 * wanted)
