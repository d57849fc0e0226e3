"""A corpus pipeline: documents without toxic ones, one of each group of near duplicates, without benchmark passages, with
personal data masked, packed into sequences.

Each stage's rows are written as Parquet in the shared folder and read again by the next. All but the last stage return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameops.llm import decontaminate, jaccard, packing, pii, toxicity
from frameops.llm.tables import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Columns of ``docs`` are set aside under other names, so that none clashes with one that ``judge`` adds."""
    aside = {c: f"column{i}_of_documents" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return judge(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of rejection."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda d: toxicity.score(d, chain).where(F.col("toxicity") < toxicity.REJECT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link."""
    return jaccard.one_of_each(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _judged(docs, lambda d: decontaminate.decontaminate(d, benchmark).where(~F.col("contaminated")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked; n_chars follows where the text has changed."""
    field = pii.train(docs)

    def judge(d: DataFrame) -> DataFrame:
        masked = pii.mask(d, field)
        if "n_chars" not in docs.columns:
            return masked
        name = next(c for c, old in zip(d.columns, docs.columns) if old == "n_chars")
        return masked.withColumn(name, F.when(F.col("n_spans") > 0, F.length("text")).otherwise(F.col(name)).cast(d.schema[name].dataType))

    return _judged(docs, judge)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and offset."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The stages hold trained models and iterative joins, which SQL cannot express; tests compare them with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
