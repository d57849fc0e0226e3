"""Best-fit packing with certified bounds.

Every document becomes token ids closed by id 0; only longer ones are cut into full pieces and a rest. Full pieces fill a
sequence each. The others are dealt evenly into partitions, each packed by best-fit decreasing. Dual-feasible functions give a
lower bound on a partition's sequences; where the bound is met the partition is certified as optimal. Partitions with a gap
give away the documents of their sequences that are not full, certified ones those of their emptiest sequence: these are dealt
anew, sequence by sequence, so that they meet those of other partitions, and best-fit decreasing runs again. A new packing
replaces the old one only where it needs fewer sequences. Rounds end when a round saves no sequence, or when all sequences
together meet the bound of all pieces, which comes from a count by length. Partitions hold a bounded number of pieces at every
size of the input.

Defined results: a null or empty text is the single id 0; repeated rows are packed one by one.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm.tables import Scratch
from frameops.llm.tokens import encoder

CAPACITY = 2048
#: Pieces of a partition in the first round and in exchanges.
GROUP, EXCHANGE_GROUP = 1024, 256

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
_PACKED = f"{_PIECES}, sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece; ``deal`` is a number of its own for every row, repeated rows too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, length, start, piece, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(vocabulary).encode(batch["text"])):
                whole = np.append(ids, np.uint32(0)).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            deal = np.arange(task, task + len(rows))
            task += len(rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(deal)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(room, (need, -1))
        if at < len(room):
            left, chosen = room.pop(at)
        else:
            left, chosen, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = chosen, capacity - left
        if left > need:
            bisect.insort(room, (left - need, chosen))
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """The best of some dual-feasible functions: sums of f(length) never exceed the number of bins.

    The plain sum; for each threshold t up to half the capacity the function that counts pieces over capacity - t whole, drops
    those below t and keeps the others; and for k = 1..12 the rounding to multiples of 1/k, exact on multiples of 1/(k + 1).
    ``counts`` tells how many pieces have each length, one each by default.
    """
    order = np.argsort(lengths, kind="stable")
    values = lengths[order].astype(np.int64)
    counts = np.ones(len(values), np.int64) if counts is None else counts[order].astype(np.int64)
    sums, below = (np.concatenate([[0], np.cumsum(x)]) for x in (values * counts, counts))
    best = -(-int(sums[-1]) // capacity)
    cuts = np.unique(np.minimum(values, capacity - values))
    cuts = cuts[(cuts > 0) & (cuts <= capacity // 2)]
    high = np.searchsorted(values, capacity - cuts, "right")
    low = np.minimum(np.searchsorted(values, cuts, "left"), high)
    if len(cuts):
        best = max(best, int(np.max(below[-1] - below[high] + -(-(sums[high] - sums[low]) // capacity))))
    for k in range(1, 13):
        scaled = (k + 1) * values
        exact = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        total = int((np.where(exact, values * k, scaled // capacity * capacity) * counts).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def _pack(frame: pd.DataFrame, round_number: int, capacity: int) -> pd.DataFrame:
    lengths = frame["length"].to_numpy()
    bins, offsets = best_fit_decreasing(lengths, capacity)
    count, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    out = frame.drop(columns=["part"])
    before = frame["sequence_id"].nunique() if round_number else None
    if before is not None and count >= before:
        # no sequence saved: the pieces stay where they are; only the certificate may have changed
        bins, count = np.unique(frame["sequence_id"].to_numpy(), return_inverse=True)[1], before
    else:
        out = out.assign(sequence_id=(round_number << 50) | (int(frame["part"].iloc[0]) << 12) | bins, offset=offsets)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    given = filled < capacity
    if count <= bound:
        given &= np.arange(count) == np.argmin(filled)
    return out.assign(open=given[bins])


def _packer(round_number: int, capacity: int):
    return lambda frame: _pack(frame, round_number, capacity)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset that each one gets."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, vocabulary, capacity), "pieces")
    full = cut.where(F.col("length") == capacity)
    done = [full.select("*", (F.col("deal") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("open"))]
    waiting = cut.where(F.col("length") < capacity)
    # a row for each length below the capacity at most
    sizes = waiting.groupBy("length").agg(F.count("*").alias("pieces")).toPandas()
    rows, bound = int(sizes["pieces"].sum()), lower_bound(sizes["length"].to_numpy(), capacity, sizes["pieces"].to_numpy())
    # sequences that have left for good, and those whose pieces are dealt anew
    kept, given = 0, None
    size, key, number = GROUP, "deal", 0
    while rows:
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.lit(number), key), F.lit(-(-rows // size))))
        packed = scratch.keep(dealt.groupBy("part").applyInPandas(_packer(number, capacity), _PACKED), "packed")
        # a sequence has one piece at its beginning
        first = F.col("offset") == 0
        sequences, still, rows = packed.agg(F.count_if(first), F.count_if(first & F.col("open")), F.count_if("open")).first()
        if kept + sequences <= bound or still <= 1 or given is not None and sequences >= given:
            done.append(packed)
            break
        done.append(packed.where(~F.col("open")))
        waiting, kept, given = packed.where("open"), kept + sequences - still, still
        size, key, number = EXCHANGE_GROUP, "sequence_id", number + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
