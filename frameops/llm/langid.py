"""Language identification by bit-sliced Bloom filters over n-grams.

Texts become lower-case bytes with every ASCII character that is no letter as a space; n-grams are runs of three and of four
bytes. Each language has a Bloom filter for each n, and the filters lie bit-sliced: slot s holds one bit for every language,
so a lookup of an n-gram's slots and one AND return all languages that contain it, at the same cost for any number of
languages in a byte of the slice. Per language, the hits of a text are counted, the number expected from false positives is
taken out by the filter's fill, and the highest share of the text's n-grams decides.

An n-gram belongs to a language if it is frequent enough there, in itself and against the language that has it most.
Training reads about ``TRAIN_DOCS`` documents of each language, never more than twice as many, chosen by a hash of the id,
whole; the ``LANGUAGES`` most frequent values of lang are learned, equal ones in alphabetical order. Texts are counted where
they lie; the driver sees one row for each n-gram that a filter takes, of which three and four bytes set the limit.

Defined results: held_out is null for a null id; ``und`` with score 0 for a null text or one without a letter; a text whose n-grams no language contains gets
the most frequent language of the sample with score 0; ties go to the more frequent language; repeated rows are judged one by
one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm import words as W
from frameops.llm.rows import add_columns
from frameops.llm.tables import Scratch
from frameops.llm.toxicity import fold

TRAIN_DOCS, LANGUAGES = 500, 256
SIZES = (3, 4)
#: Slots of a filter by powers of two, hash functions, least count of an n-gram and least share of its highest frequency.
SLOT_BITS, HASHES, LEAST, SHARE = 20, 2, 3, 0.3
UNKNOWN = "und"

_LETTER = re.compile("[A-Za-z]")
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _letters() -> np.ndarray:
    byte = np.arange(256)
    lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    return np.where((lower < 0x80) & ~((lower >= 0x61) & (lower <= 0x7A)), 0x20, lower).astype(np.uint64)


_BYTES = _letters()


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram as a number and the document it belongs to; runs across documents and runs of spaces are left out."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = _BYTES[data]
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | values[i : i + count]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = np.uint64(int.from_bytes(b" " * n, "big"))
    keep = (doc[:count] == doc[n - 1 :]) & (out != blank)
    return out[keep], doc[:count][keep]


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text))


class Filters:
    """Bit-sliced filters: for each n an array of slots by bytes of languages."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.slices = {n: np.zeros((max(1, -(-len(languages) // 8)), 1 << SLOT_BITS), np.uint8) for n in SIZES}
        self.false = {n: np.zeros(len(languages)) for n in SIZES}

    def slots(self, values: np.ndarray) -> list[np.ndarray]:
        return [(W.mix(values * factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for factor in _FACTORS[:HASHES]]

    def insert(self, n: int, language: int, values: np.ndarray) -> None:
        for slots in self.slots(values):
            self.slices[n][language // 8, slots] |= np.uint8(1 << language % 8)

    def seal(self) -> None:
        """Chance of a false hit by language: its share of set slots, once for each hash function."""
        for n in SIZES:
            for k in range(len(self.languages)):
                self.false[n][k] = float(((self.slices[n][k // 8] >> (k % 8)) & 1).mean()) ** HASHES

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of each document's n-grams that each language contains."""
        docs, n_languages = len(offsets) - 1, len(self.languages)
        hits, total = np.zeros((docs, n_languages)), np.zeros(docs)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for n in SIZES:
            values, doc = ngrams(data, offsets, n)
            seen = np.bincount(doc, minlength=docs)
            found = np.zeros((docs, 8 * len(self.slices[n])))
            slots = self.slots(values)
            for k, part in enumerate(self.slices[n]):
                mask = part[slots[0]]
                for other in slots[1:]:
                    mask = mask & part[other]
                found[:, 8 * k : 8 * k + 8] = np.bincount(doc * 256 + mask, minlength=docs * 256).reshape(docs, 256) @ bits
            hits += (found[:, :n_languages] - seen[:, None] * self.false[n]) / (1 - self.false[n])
            total += seen
        return np.maximum(hits, 0) / np.maximum(total, 1)[:, None]


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS, most: int = LANGUAGES) -> tuple[list[str], DataFrame]:
    """Languages, the most frequent first, and the rows (language as a place in that list, text) that filters learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1))
    ranked = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not ranked:
        return [], known.select(F.lit(0).alias("language"), "text").limit(0)
    share = F.create_map(*[x for r in ranked for x in (F.lit(r.lang), F.lit(per_language / r.n))])
    place = F.create_map(*[x for k, r in enumerate(ranked) for x in (F.lit(r.lang), F.lit(k))])
    order = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20))
    picked = known.where(order / (1 << 20) < share[F.col("lang")]).select(place[F.col("lang")].alias("language"), "text", order.alias("chance"), "doc_id")
    # the limit matters only where one id has many rows; the text decides between rows of one id
    within = Window.partitionBy("language").orderBy("chance", "doc_id", F.xxhash64("text"))
    rows = picked.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= 2 * per_language)
    return [r.lang for r in ranked], rows.select("language", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each language in a chunk of texts."""
    for batch in batches:
        data, offsets = W.text_bytes(batch["text"])
        language = batch["language"].to_numpy()
        for low, high in W.chunks(offsets):
            for n in SIZES:
                grams, doc = ngrams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], n)
                of = language[low:high][doc]
                for k in np.unique(of):
                    values, count = np.unique(grams[of == k], return_counts=True)
                    size = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, n, np.int32)), pa.array(values.astype(np.int64)), pa.array(count)], names=["language", "n", "gram", "count"])


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, most: int = LANGUAGES) -> Filters:
    """Filters from rows that are not held out."""
    languages, rows = sample(docs, per_language, most)
    filters = Filters(languages)
    if not languages:
        return filters
    counted = rows.mapInArrow(_count, "language int, n int, gram long, count long").groupBy("language", "n", "gram").agg(F.sum("count").alias("count"))
    counted = Scratch(docs.sparkSession, "language").keep(counted, "ngrams")
    # a row for each language and size of n-grams
    totals = counted.groupBy("language", "n").agg(F.sum("count").alias("total"))
    frequency = counted.join(F.broadcast(totals), ["language", "n"]).withColumn("frequency", F.col("count") / F.col("total"))
    highest = F.max("frequency").over(Window.partitionBy("n", "gram"))
    taken = frequency.withColumn("highest", highest).where((F.col("count") >= LEAST) & (F.col("frequency") >= SHARE * F.col("highest")))
    found = taken.select("language", "n", "gram").toArrow()
    columns = [found[c].to_numpy() for c in ("language", "n", "gram")]
    for n in SIZES:
        for k in range(len(languages)):
            filters.insert(n, k, columns[2][(columns[0] == k) & (columns[1] == n)].astype(np.uint64))
    filters.seal()
    return filters


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the best language's part of what it and the next one contain) and the languages' shares."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def compute(batch: pa.RecordBatch) -> dict[str, list]:
        column = batch.column(batch.schema.get_field_index(text_col))
        data, offsets = W.text_bytes(column)
        names = model.value.languages
        predicted, scores, all_shares = [], [], []
        for low, high in W.chunks(offsets):
            shares = model.value.shares(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) if names else np.zeros((high - low, 0))
            for i, row in zip(range(low, high), shares):
                lettered = len(names) and has_letter(column[i].as_py())
                order = np.argsort(-row, kind="stable")
                best, next_best = (row[order[k]] if k < len(row) else 0.0 for k in (0, 1))
                predicted.append(names[order[0]] if lettered else UNKNOWN)
                scores.append(float(best / (best + next_best)) if lettered and best > 0 else 0.0)
                all_shares.append(row.tolist())
        return {"lang_pred": predicted, "score": scores, "lang_shares": all_shares}

    return add_columns(docs, "lang_pred string, score double, lang_shares array<double>", compute)


def language_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    named = identify(docs.select("doc_id", "text"), train(docs))
    return named.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
