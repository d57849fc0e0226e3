"""Benchmark decontamination by winnowing.

A window is ``SPAN`` consecutive words of a benchmark item, or a whole item of fewer words. Every k-gram of words has a hash;
of each ``SPAN - K + 1`` neighbouring k-grams, which cover SPAN words, the smallest is kept as a fingerprint on both sides, so
a shared window always shares a fingerprint. Fingerprints of a document that an item also has are extended: each window of
SPAN words around them is looked up among the items' windows. Items below SPAN words have one window each, looked up by
its own length.

A benchmark of at most ``BROADCAST_BYTES`` of text goes to the executors in blocks of ``BLOCK_BYTES``. Every block is one pass
over the documents' rows in place, chained, so the documents are not shuffled. A larger one never meets the driver: executors
winnow the items, a bitmap of fixed size tells documents which of their fingerprints and of the windows around them may be
in it, and these windows are joined with the items' windows by a shuffle, each item window dealt to ``SALTS`` keys so that a
passage many documents share is no single task. Documents are then joined with their hits once. Both ways give equal rows.

Defined results: a null or wordless text has no words and no hits; null or wordless items have no window; repeated document
rows are judged one by one; repeated items count once by id; an item without an id counts under the empty id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm import words as W
from frameops.llm.rows import add_columns
from frameops.llm.tables import Scratch

SPAN, K = 10, 5
BLOCK_BYTES, BROADCAST_BYTES, SALTS = 8_000_000, 32_000_000, 16
#: Bits of the map of item hashes, and bits of one row of it.
MAP_BITS, MAP_ROW = 1 << 26, 32_768
#: Bytes of a row besides its text.
_ROW_BYTES = 64
_FILTER_BITS = 1 << 16
_STATE = "n_words long, hit_words binary, items array<string>"
_RESULT = "n_words long, items array<string>, n_hit long, hit_spans array<struct<start: long, end: long>>, contaminated boolean"


def _winnow(values: np.ndarray, width: int) -> np.ndarray:
    """Positions whose value is the smallest of some ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = values[:n].copy()
    for i in range(1, width):
        np.minimum(low, values[i : i + n], out=low)
    chosen = np.zeros(len(values), bool)
    for i in range(width):
        chosen[i : i + n] |= values[i : i + n] == low
    return np.flatnonzero(chosen)


class _Lookup:
    """Sorted hashes with the item indices of each, behind a small bit filter."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray) -> None:
        pairs = np.unique(np.stack([hashes, items.astype(np.uint64)], 1), axis=0) if len(hashes) else np.zeros((0, 2), np.uint64)
        self.hash, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.item = pairs[:, 1].astype(np.int64)
        self.filter = np.zeros(_FILTER_BITS, bool)
        self.filter[(self.hash & np.uint64(_FILTER_BITS - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` that are present, and their places here."""
        at = np.flatnonzero(self.filter[(values & np.uint64(_FILTER_BITS - 1)).astype(np.int64)]) if len(self.hash) else np.zeros(0, np.int64)
        place = np.searchsorted(self.hash, values[at])
        good = self.hash[np.minimum(place, len(self.hash) - 1)] == values[at] if len(at) else np.zeros(0, bool)
        return at[good], place[good]

    def items_of(self, places: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.item[self.first[p] : self.first[p + 1]] for p in np.unique(places)])) if len(places) else np.zeros(0, np.int64)


class Block:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, ids: list[str], texts: list[str]) -> None:
        self.ids = np.array(ids, object)
        prints, windows, at = [], [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for low, _, w in W.each_chunk(pa.array(texts, pa.large_string()), "alnum"):
            kgrams, spans = W.grams(w.hash, K), W.grams(w.hash, SPAN)
            for i in range(len(w.first) - 1):
                a, b = w.first[i], w.first[i + 1]
                if b - a >= SPAN:
                    own = kgrams[a : b - K + 1]
                    prints.append(own[_winnow(own, SPAN - K + 1)])
                    windows.append(spans[a : b - SPAN + 1])
                    at.append(np.full(b - a - SPAN + 1, low + i))
                elif b > a:
                    short.setdefault(int(b - a), []).append((int(W.grams(w.hash[a:b], int(b - a))[0]), low + i))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        values = join(prints, np.uint64)
        self.prints = _Lookup(values, np.zeros(len(values), np.int64))
        self.windows = _Lookup(join(windows, np.uint64), join(at, np.int64))
        self.short = {n: _Lookup(np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found])) for n, found in short.items()}

    def hits(self, w: W.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, _Lookup]]:
        """Window length, first words of hits and the places of their windows in the lookup."""
        if len(self.prints.hash):
            kgrams = W.grams(w.hash, K)
            chosen = _winnow(kgrams, SPAN - K + 1)
            at, _ = self.prints.find(kgrams[chosen])
            if len(at):
                spans = W.grams(w.hash, SPAN)
                begin = np.unique((chosen[at][:, None] - np.arange(SPAN - K + 1)).ravel())
                begin = begin[(begin >= 0) & (begin < len(spans))]
                good, place = self.windows.find(spans[begin])
                yield SPAN, begin[good], place, self.windows
        for n, lookup in self.short.items():
            yield n, *lookup.find(W.grams(w.hash, n)), lookup

    def mark(self, column: pa.Array, covered: list[np.ndarray], items: list[set[str]]) -> None:
        """Add this block's hits: covered words (one flag array per row) and item ids."""
        for low, high, w in W.each_chunk(column, "alnum"):
            doc = W.doc_of(w)
            for n, begin, place, lookup in self.hits(w):
                inside = doc[begin] == doc[begin + n - 1]
                begin, place = begin[inside], place[inside]
                if not len(begin):
                    continue
                edges = np.zeros(len(doc) + 1, np.int32)
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + n, -1)
                flags = np.cumsum(edges[:-1]) > 0
                bounds = np.searchsorted(doc[begin], np.arange(high - low + 1))
                for i in np.unique(doc[begin]):
                    own = flags[w.first[i] : w.first[i + 1]]
                    covered[low + i] = own if covered[low + i] is None else covered[low + i] | own
                    items[low + i].update(self.ids[lookup.items_of(place[bounds[i] : bounds[i + 1]])])


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").where(F.col("text").isNotNull())
    for item_id, text in rows.toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def _place(hashes: np.ndarray, k: int) -> np.ndarray:
    """Bits of hashes of k words in the map of item hashes; fingerprints have k = 0."""
    return (W.mix(hashes + np.uint64(k)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (k, hash, item) and fingerprints (0, hash, null) of items, with their bits of the map."""
    for batch in batches:
        for low, high, w in W.each_chunk(batch["text"], "alnum"):
            kgrams = W.grams(w.hash, K)
            for i in range(high - low):
                a, b = int(w.first[i]), int(w.first[i + 1])
                if b == a:
                    continue
                k = min(SPAN, b - a)
                parts = [(k, np.unique(W.grams(w.hash[a:b], k)), batch["item"][low + i].as_py())]
                if k == SPAN:
                    own = kgrams[a : b - K + 1]
                    parts.append((0, np.unique(own[_winnow(own, SPAN - K + 1)]), None))
                for k, values, item in parts:
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(values.view(np.int64)), pa.array([item] * n, pa.string()), pa.array(_place(values, k) + 1)], names=["k", "hash", "item", "bit"])


def _near_items(bits, lengths: list[int], text_col: str):
    """Windows of documents that the map may hold, those of SPAN words only around fingerprints that it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        maybe = lambda values, k: (known[_place(values, k) >> 3] >> (_place(values, k) & 7)) & 1 > 0
        for batch in batches:
            rows = batch["row"].to_numpy()
            for low, _, w in W.each_chunk(batch[text_col], "alnum"):
                doc = W.doc_of(w)
                for k in lengths:
                    values = W.grams(w.hash, k)
                    begin = np.arange(len(values))
                    if k == SPAN:
                        kgrams = W.grams(w.hash, K)
                        chosen = _winnow(kgrams, SPAN - K + 1)
                        chosen = chosen[maybe(kgrams[chosen], 0)]
                        begin = np.unique((chosen[:, None] - np.arange(SPAN - K + 1)).ravel())
                        begin = begin[(begin >= 0) & (begin < len(values))]
                    begin = begin[maybe(values[begin], k)]
                    begin = begin[doc[begin] == doc[begin + k - 1]]
                    at = doc[begin]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[low + at]), pa.array(np.full(len(at), k, np.int32)), pa.array(values[begin].view(np.int64)), pa.array(begin - w.first[at])], names=["row", "k", "hash", "begin"])

    return run


def _joined(docs: DataFrame, benchmark: DataFrame, text_col: str) -> DataFrame:
    """The result by a join of windows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    hashes = scratch.keep(items.mapInArrow(_item_hashes, "k int, hash long, item string, bit long").distinct(), "items")
    lengths = [r.k for r in hashes.where("k > 0").select("k").distinct().collect()]
    # MAP_BITS / MAP_ROW rows at most
    rows = hashes.groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        # rows of bitmaps begin at 1, and so do the bits in them
        place = (r["at"] - 1) * (MAP_ROW // 8)
        whole[place : place + MAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    bits = spark.sparkContext.broadcast(whole.tobytes())
    # row numbers that a lost executor does not change
    kept = scratch.keep(docs.withColumn("row_of_docs", F.monotonically_increasing_id()), "documents")
    near = kept.select(F.col("row_of_docs").alias("row"), text_col).mapInArrow(_near_items(bits, lengths, text_col), "row long, k int, hash long, begin long")
    salted = hashes.where("k > 0").select("k", "hash", "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = near.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["k", "hash", "salt"])
    hits = found.groupBy(F.col("row").alias("row_of_docs")).agg(F.collect_set(F.struct("begin", "k")).alias("places_of_docs"), F.array_sort(F.collect_set("item")).alias("items_of_docs"))

    def compute(batch: pa.RecordBatch) -> dict[str, list]:
        column = batch.column(batch.schema.get_field_index(text_col))
        counts = np.concatenate([np.diff(w.first) for _, _, w in W.each_chunk(column, "alnum")])
        covered = []
        for n, places in zip(counts, batch["places_of_docs"]):
            if not places.is_valid:
                covered.append(None)
                continue
            begin, k = (places.values.field(name).to_numpy() for name in ("begin", "k"))
            edges = np.zeros(n + 1, np.int32)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + k, -1)
            covered.append(np.cumsum(edges[:-1]) > 0)
        return {"n_words": counts, "items": [x or [] for x in batch["items_of_docs"].to_pylist()]} | _results(covered)

    joined = kept.join(hits, "row_of_docs", "left")
    return add_columns(joined, _RESULT, compute).drop("row_of_docs", "places_of_docs", "items_of_docs", "hit_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (ranges of words [start, end) that items share), items (sorted ids), contaminated."""
    context = docs.sparkSession.sparkContext
    size = benchmark.agg(F.sum(F.octet_length("text") + F.lit(_ROW_BYTES))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, benchmark, text_col)
    blocks = [context.broadcast(block) for block in _blocks(benchmark, block_bytes)] or [None]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        docs = add_columns(docs, _RESULT if last else _STATE, _marker(block, text_col, i == 0, last))
    return docs.drop("hit_words")


def _results(covered: list) -> dict[str, list]:
    """The columns that follow from flags of covered words, one array per row or None."""
    out: dict[str, list] = {"n_hit": [], "hit_spans": [], "contaminated": []}
    for own in covered:
        edges = np.zeros(0, np.int64) if own is None else np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8)))
        out["n_hit"].append(0 if own is None else int(own.sum()))
        out["hit_spans"].append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
        out["contaminated"].append(len(edges) > 0)
    return out


def _marker(block, text_col: str, fresh: bool, last: bool):
    def compute(batch: pa.RecordBatch) -> dict[str, list]:
        column = batch.column(batch.schema.get_field_index(text_col))
        n = batch.num_rows
        covered: list = [None] * n
        items: list[set[str]] = [set() for _ in range(n)]
        if block is not None:
            block.value.mark(column, covered, items)
        if fresh:
            counts = np.concatenate([np.diff(w.first) for _, _, w in W.each_chunk(column, "alnum")])
        else:
            counts = np.array(batch["n_words"])
            for i, (packed, before) in enumerate(zip(batch["hit_words"].to_pylist(), batch["items"].to_pylist())):
                if packed:
                    own = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(counts[i])).astype(bool)
                    covered[i] = own if covered[i] is None else covered[i] | own
                    items[i].update(before)
        out = {"n_words": counts, "items": [sorted(s) for s in items]}
        return out | (_results(covered) if last else {"hit_words": [None if own is None else np.packbits(own).tobytes() for own in covered]})

    return compute


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
