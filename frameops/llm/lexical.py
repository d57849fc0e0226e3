"""Ranked lexical search with per-term geometric blocks that are skipped by exact bounds.

A document is a sparse vector: the impact of each term that some item asks for. Documents are ordered by the signs of a short
random projection of that vector and read shard by shard, each bounded by its rows and entries. Within a shard the posting list
of a term is clustered by the similarity of its documents (nearest of a few pivots among them) and cut into blocks; a block keeps
the coordinatewise maximum of its documents' impacts. For an item, the maximum's product with the item's weights bounds every
score in the block. Blocks are read from the largest bound down; one is skipped only when its bound is below the item's k-th best
score. Lists are read from the heaviest term down; the rest stays unread only when the shard's own maxima of all remaining terms
together stay below that score. What is read is scored exactly, in whole numbers. Each task keeps the bars of all items from
shard to shard and returns its best documents per item; these are merged across tasks.

Items come in groups of bounded vocabulary, one group at a time, so that what tasks hold has a proven size; a group's texts are
the only rows the driver sees.

Defined results: null and empty texts have no terms and are not counted; items without terms have no rows, and so have items no
document scores above 0 for. Repeated documents are ranked each, null ids after all others among equals. Rows that repeat an
item_id are items of their own. Long texts are read whole, in chunks of whole documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameops.llm.rows import add_columns
from frameops.llm.tables import Scratch
from frameops.llm.words import doc_of, each_chunk

BEST = 20
#: Items and bytes of item text of a group, documents of a shard and of a block, width of the projection.
GROUP_ITEMS, GROUP_BYTES, SHARD_ROWS, BLOCK_ROWS, SKETCH = 1024, 200_000, 2048, 32, 16
#: Cells of a shard's table of impacts, and of the maxima of its blocks.
SHARD_CELLS = 16_000_000
_FOUND = "row long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


class Items(NamedTuple):
    """A group of items: their row numbers, and terms with counts as ranges of flat arrays."""

    row: np.ndarray
    first: np.ndarray
    term: np.ndarray
    count: np.ndarray
    vocabulary: np.ndarray


def read_items(rows: list) -> Items:
    """Items from rows (row, text)."""
    names, first, terms, counts = [], [0], [], []
    for low, _, words in each_chunk(pa.array([r.text for r in rows], pa.string()), "alnum"):
        for i in range(len(words.first) - 1):
            own, many = np.unique(words.hash[words.first[i] : words.first[i + 1]], return_counts=True)
            if len(own):
                names.append(rows[low + i].row)
                terms.append(own)
                counts.append(many)
                first.append(first[-1] + len(own))
    vocabulary, term = np.unique(np.concatenate(terms), return_inverse=True) if terms else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Items(np.array(names, np.int64), np.array(first), term, np.concatenate(counts) if counts else np.zeros(0, np.int64), vocabulary)


def _signs(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(41)).standard_normal((n, SKETCH)).astype(np.float32)


def _count_terms(model, batch: pa.RecordBatch) -> dict[str, list]:
    """Per document its number of terms, and the asked ones with their occurrences."""
    vocabulary = model.value.vocabulary
    signs, total, terms, counts, order = _signs(len(vocabulary)), [], [], [], []
    for _, _, words in each_chunk(batch["text"], "alnum"):
        n = len(words.first) - 1
        total += np.diff(words.first).tolist()
        place = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        asked = vocabulary[place] == words.hash
        pairs, many = np.unique(doc_of(words)[asked] * len(vocabulary) + place[asked], return_counts=True)
        doc, term = pairs // len(vocabulary), pairs % len(vocabulary)
        sketch = np.zeros((n, SKETCH))
        held, begin = np.unique(doc, return_index=True)
        if len(held):
            sketch[held] = np.add.reduceat((1 + np.log(many))[:, None] * signs[term], begin, axis=0)
        order += ((sketch > 0) @ (1 << np.arange(SKETCH)[::-1])).tolist()
        bounds = np.searchsorted(doc, np.arange(n + 1))
        terms += np.split(term, bounds[1:-1])
        counts += np.split(many, bounds[1:-1])
    return {"n_terms": total, "terms": terms, "counts": counts, "place": order}


class Shard:
    """Documents of a shard as a dense table of impacts over the terms they hold, and the blocks of each list once it is read."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        self.ids = ids
        self.terms, column = np.unique(term, return_inverse=True)
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        self.impacts = np.zeros((len(ids), len(self.terms)), np.int32)
        self.impacts[doc, column] = impact
        self.most = self.impacts.max(0).astype(np.int64)
        order = np.argsort(column, kind="stable")
        self.list_doc, self.list_first = doc[order], np.searchsorted(column[order], np.arange(len(self.terms) + 1))
        sketch = np.log1p(self.impacts) @ _signs(len(self.terms))
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.made: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}

    def blocks(self, column: int, asked: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Documents of each block of a term's list, and the maxima of the blocks in the columns ``asked``."""
        docs = self.list_doc[self.list_first[column] : self.list_first[column + 1]]
        if len(docs) <= BLOCK_ROWS:
            return [docs], self.impacts[docs[:, None], asked].max(0, keepdims=True)
        if column not in self.made:
            pivots = docs[:: BLOCK_ROWS // 2]
            docs = docs[np.argsort((self.sketch[docs] @ self.sketch[pivots].T).argmax(1), kind="stable")]
            starts = np.arange(0, len(docs), BLOCK_ROWS)
            self.made[column] = np.split(docs, starts[1:]), np.maximum.reduceat(self.impacts[docs], starts, axis=0)
        blocks, most = self.made[column]
        return blocks, most[:, asked]


class Search:
    """The best documents of each item of a group so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int) -> None:
        self.items, self.k = items, k
        self.weight = weights[items.term] * items.count
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items.row]
        self.bar = np.zeros(len(items.row), np.int64)

    def read(self, shard: Shard) -> None:
        place = np.searchsorted(shard.terms, self.items.term)
        place = np.minimum(place, len(shard.terms) - 1)
        held = shard.terms[place] == self.items.term if len(shard.terms) else np.zeros(len(place), bool)
        for i in range(len(self.items.row)):
            own = slice(self.items.first[i], self.items.first[i + 1])
            columns, weight = place[own][held[own]], self.weight[own][held[own]]
            if len(columns):
                self._read_item(shard, i, columns, weight)

    def _read_item(self, shard: Shard, i: int, columns: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(-weight * shard.most[columns], kind="stable")
        columns, weight = columns[order], weight[order]
        # what the terms from each one on can add to a document that holds none of those before
        tail = np.cumsum((weight * shard.most[columns])[::-1])[::-1]
        seen = np.zeros(len(shard.ids), bool)
        for column, rest in zip(columns, tail):
            if rest < max(1, self.bar[i]):
                break
            blocks, most = shard.blocks(column, columns)
            bound = most.astype(np.int64) @ weight
            for b in np.argsort(-bound, kind="stable"):
                if bound[b] < max(1, self.bar[i]):
                    break
                docs = blocks[b][~seen[blocks[b]]]
                seen[docs] = True
                if len(docs):
                    self._add(i, shard.ids[docs], shard.impacts[docs[:, None], columns].astype(np.int64) @ weight)

    def _add(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= max(1, self.bar[i])
        if not good.any():
            return
        ids, score = np.concatenate([self.best[i][0], ids[good]]), np.concatenate([self.best[i][1], score[good]])
        first = np.lexsort((ids, -score))[: self.k]
        self.best[i] = ids[first], score[first]
        if len(first) == self.k:
            self.bar[i] = score[first[-1]]


def _search(model, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best documents of each item among those of a task."""
    items, weights, documents, length = model.value
    search, held, rows, entries = Search(items, weights, k), [], 0, 0
    most_rows = max(1, min(SHARD_ROWS, SHARD_CELLS // len(items.vocabulary)))
    most_entries = SHARD_CELLS * BLOCK_ROWS // (2 * len(items.vocabulary))

    def flush() -> None:
        nonlocal held, rows, entries
        if held:
            ids, first, term, count, n = zip(*held)
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for f in first]))])
            m = 75 + (25 * np.concatenate(n) * documents) // length
            count = np.concatenate(count)
            impact = (1_000_000_000 * count) // (1000 * count + 12 * np.repeat(m, np.diff(first)))
            search.read(Shard(np.concatenate(ids), first, np.concatenate(term), impact))
        held, rows, entries = [], 0, 0

    for batch in batches:
        ids = batch["doc_id"].fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        first = batch["terms"].offsets.to_numpy().astype(np.int64)
        term, count = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
        first, n = first - first[0], batch["n_terms"].to_numpy()
        low = 0
        while low < len(ids):
            high = min(len(ids), low + most_rows - rows, int(np.searchsorted(first, first[low] + most_entries - entries, "right")) - 1)
            if high > low or not held:
                high = max(high, low + 1)
                held.append((ids[low:high], first[low : high + 1], term[first[low] : first[high]], count[first[low] : first[high]], n[low:high]))
                rows, entries, low = rows + high - low, entries + int(first[high] - first[low]), high
            if low < len(ids):
                flush()
    flush()
    for i, (ids, score) in enumerate(search.best):
        if len(ids):
            row = pa.array(np.full(len(ids), items.row[i]))
            yield pa.RecordBatch.from_arrays([row, pa.array(ids, mask=ids == _NO_ID), pa.array(score)], names=["row", "doc_id", "score"])


def _weights(items: Items, held: dict[int, int], documents: int) -> np.ndarray:
    held_by = [held.get(t, 0) for t in range(len(items.vocabulary))]
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held_by], np.int64)


def search_group(scratch: Scratch, documents: DataFrame, items: Items, k: int = BEST) -> DataFrame:
    """Rows (row, doc_id, score), written: the best documents of each item of a group, by task."""
    context = documents.sparkSession.sparkContext
    model = context.broadcast(items)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = add_columns(docs, "n_terms long, terms array<int>, counts array<int>, place int", lambda batch: _count_terms(model, batch))
    counted = scratch.keep(counted.drop("text"), "counted")
    n, total = counted.where("n_terms > 0").agg(F.count("*"), F.sum("n_terms")).first()
    # at most one row for each term of the group
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = context.broadcast((items, _weights(items, {r["term"]: r["count"] for r in held}, n), n, total or 1))
    found = counted.where(F.size("terms") > 0).repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    found = scratch.keep(found.mapInArrow(lambda it: _search(weights, k, it), _FOUND), "found")
    scratch.drop(counted)
    model.unpersist()
    weights.unpersist()
    return found


def search(documents: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best rows of ``documents`` (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lexical")
    # written before use, so that the row numbers stay what they are
    asked = scratch.keep(items.select("item_id", "text", F.monotonically_increasing_id().alias("row")), "items")
    found = spark.createDataFrame([], _FOUND)
    for group in _groups(asked):
        if len(group.vocabulary):
            found = found.union(search_group(scratch, documents, group, k))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _groups(asked: DataFrame) -> Iterator[Items]:
    """Items in groups of at most ``GROUP_ITEMS`` rows and ``GROUP_BYTES`` of text, or one longer text; the driver holds one at a time."""
    held, size = [], 0
    for row in asked.where(F.octet_length("text") > 0).toLocalIterator():
        bytes_of = len(row["text"].encode())
        if held and (len(held) == GROUP_ITEMS or size + bytes_of > GROUP_BYTES):
            yield read_items(held)
            held, size = [], 0
        held.append(row)
        size += bytes_of
    if held:
        yield read_items(held)
