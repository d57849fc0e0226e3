"""N-gram Jaccard join by T-occurrence search.

A document's set holds its distinct 5-word shingles. Two sets link when 100 * intersection >= 80 * union, so a document of n
shingles needs T = ceil(0.8 n) common ones with any partner. Its inverted lists are split as DivideSkip does: the L = T - 1
longest lists are left out of the merge, and a partner must then occur at least T - L = 1 time in the n - T + 1 short ones.

1. One pass over the texts gives each row its set size and a 128-bit signature of its set; equal sets fall together and only one
   document of them searches. The same pass reports shingles that repeat within a chunk of text. Their counts are added up
   into a sketch of fixed size, which orders lists by length. The order only decides which lists count as long; any order
   gives the same links.
2. The short lists are merged by a shuffle sorted by shingle; lists of one document end there.
3. Neighbours in a list are candidates. They pass a bound on the overlap from parity bitmaps, and then the exact check: the
   long lists are probed by binary search in the partner's sorted set, until the count reaches the needed overlap.
   Links found here make first components.
4. Lists that still hold several components are merged in blocks of bounded size; pairs of one component need no check any more.
   What passes the bitmap bound is checked exactly as before: first one partner of each row, which joins most of what belongs
   together, then all pairs of the components that are left. So no link between different components is lost, while a large
   group of near copies is never expanded into all its pairs.

Defined results: a null or wordless text has an empty set, links with nothing and is its own component; fewer than five words
make one shingle; repeated rows of a doc_id each get a row with that id's component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameops.llm import words as W
from frameops.llm.rows import add_columns
from frameops.llm.tables import Scratch, components

SHINGLE = 5
#: Slots of the list length sketch, and the count from which a list is ordered by its length.
SKETCH_SLOTS, LONG_LIST = 1 << 20, 32
#: Words of text in which repeats of a shingle are counted, and the repeats that are reported.
COUNT_WORDS, REPEATS = 1_000_000, 3
#: Rows of a list that meet in one block.
BLOCK_ROWS = 512


def _each_set(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for low, high, w in W.each_chunk(column, "space"):
        run = W.grams(w.hash, SHINGLE)
        for i in range(high - low):
            yield low + i, W.shingles(w, i, run, SHINGLE)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _parity(values: np.ndarray) -> bytes:
    """Parity bitmap of at least two bits per shingle, and 2048: bit b tells whether an odd number of shingles fall on b."""
    bits = 2048
    while bits < 2 * len(values):
        bits *= 2
    return np.packbits((np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


_SUMMARY = "repeat boolean, doc_id long, n long, sig_a long, sig_b long, parity binary"
_SUMMARY_NAMES = ["repeat", "doc_id", "n", "sig_a", "sig_b", "parity"]


def _signature(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        sums = np.array([W.mix(own).sum(dtype=np.uint64), W.mix(own ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)])
    return tuple(_signed(sums).tolist())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows marked ``repeat`` with a shingle in sig_a and its repeats in n."""

    def repeats(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, count = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
        values, count = values[count >= REPEATS], count[count >= REPEATS]
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), bool)), none, pa.array(count, pa.int64()), pa.array(_signed(values)), none, pa.nulls(len(values), pa.binary())], names=_SUMMARY_NAMES)

    pending: dict[tuple[int, int], np.ndarray] = {}
    size = 0
    for batch in batches:
        n, signatures, parity = [], [], []
        for _, own in _each_set(batch["text"]):
            n.append(len(own))
            signatures.append(_signature(own))
            parity.append(_parity(own) if len(own) else None)
            pending[signatures[-1]] = own
            size += len(own)
            if size > COUNT_WORDS:
                yield repeats(list(pending.values()))
                pending.clear()
                size = 0
        a, b = np.array(signatures, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), batch["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(parity, pa.binary())], names=_SUMMARY_NAMES)
    yield repeats(list(pending.values()))


def _length_sketch(spark: SparkSession, summaries: DataFrame) -> bytes:
    """Rounded logarithm of the list length by slot; at most SKETCH_SLOTS rows reach the driver."""
    slot = F.col("sig_a").bitwiseAND(SKETCH_SLOTS - 1).cast("int")
    long = summaries.where("repeat").groupBy("sig_a").agg(F.sum("n").alias("n")).where(F.col("n") >= LONG_LIST)
    sketch = np.zeros(SKETCH_SLOTS, np.uint8)
    table = long.groupBy(slot.alias("slot")).agg(F.max(F.floor(F.log2("n"))).cast("int").alias("level")).toArrow()
    sketch[table["slot"].to_numpy()] = table["level"].to_numpy()
    return sketch.tobytes()


def _short_lists(sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    level = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        ids, shared = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "shared"))
        parts, owner, sizes = [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(parts))), pa.array(np.concatenate(owner)), pa.array(np.concatenate(sizes))], names=["shingle", "doc", "n"])

        for i, own in _each_set(batch["text"]):
            n = len(own)
            if not n:
                continue
            keep = n - (4 * n + 4) // 5 + 1
            node = _node(ids[i], shared[i], own)
            order = level[(own & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64)]
            if order.any():
                own = own[np.argsort(order, kind="stable")]
            parts.append(own[:keep])
            owner.append(np.full(keep, node, np.int64))
            sizes.append(np.full(keep, n, np.int32))
            if len(parts) >= 2000:
                yield flush()
                parts, owner, sizes = [], [], []
        if parts:
            yield flush()


def _node(doc_id: int, shared: bool, own: np.ndarray) -> int:
    """A set is named by the document that stands for it; by its signature if that id has other texts too."""
    a, b = _signature(own) if shared else (0, 0)
    return a ^ (b >> 1) if shared else int(doc_id)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shared = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "shared"))
        nodes, found = [], []
        for i, own in _each_set(batch["text"]):
            nodes.append(_node(ids[i], shared[i], own))
            found.append(own.tobytes())
        for low in range(0, len(found), 500):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low : low + 500], pa.int64()), pa.array(found[low : low + 500], pa.binary())], names=["doc", "shingles"])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _may_link(n: np.ndarray, parity: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of rows can link. The bitmaps differ in no more bits than the sets differ in shingles, so a larger difference
    than the needed overlap allows rules a pair out."""
    maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in parity]
    words = np.array([len(m) for m in maps])
    size = np.minimum(words[left], words[right])
    total = n[left] + n[right]
    allowed = total - 2 * -(-4 * total // 9)
    good = np.zeros(len(left), bool)
    for s in np.unique(size):
        chosen = np.flatnonzero(size == s)
        rows, place = np.unique(np.concatenate([left[chosen], right[chosen]]), return_inverse=True)
        stacked = np.stack([_fold(maps[i], s) for i in rows])
        slab = max(1, 500_000 // int(s))
        for low in range(0, len(chosen), slab):
            part = slice(low, low + slab)
            differ = np.bitwise_count(stacked[place[: len(chosen)][part]] ^ stacked[place[len(chosen) :][part]]).sum(1, dtype=np.int64)
            good[chosen[part]] = differ <= allowed[chosen[part]]
    return good


def _reaches_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact check of candidates: probe the smaller set's shingles by binary search in the larger one."""
    for batch in batches:
        good = []
        for x, y in zip(batch["set_a"], batch["set_b"]):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            few, many = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            good.append(9 * int((many[at] == few).sum()) >= 4 * (len(a) + len(b)))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _bitmap_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_rows
        n = np.concatenate([batch["n_a"].to_numpy(), batch["n_b"].to_numpy()])
        good = _may_link(n, pa.concat_arrays([batch["parity_a"], batch["parity_b"]]), np.arange(k), np.arange(k, 2 * k))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut; a run has bounded length by construction."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for key in keys:
            values = table[key].to_numpy()
            same &= values == values[last]
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if begin:
            yield table.slice(0, begin)
        rest = table.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest


def _block_pairs(first_only: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block that are of different components, of fitting sizes and within the bitmap bound.

    With ``first_only`` a row of the block gives at most its first partner before and after it, and the lists of the pairs that
    this leaves out are named in the column ``shingle``.
    """
    for table in whole_runs(batches, ["shingle", "block"]):
        cols = {c: table[c].to_numpy() for c in ("shingle", "block", "doc", "n", "component", "side")}
        parity = table["parity"].combine_chunks()
        n = cols["n"].astype(np.int64)
        active = np.arange(table.num_rows)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(active):
            step += 1
            active = active[active + step < table.num_rows]
            other = active + step
            same = (cols["shingle"][active] == cols["shingle"][other]) & (cols["block"][active] == cols["block"][other])
            active, other = active[same], other[same]
            a, b = n[active], n[other]
            fit = (cols["component"][active] != cols["component"][other]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
            # a block of two parts only compares across them
            fit &= (cols["side"][active] == 2) | (cols["side"][active] != cols["side"][other])
            if fit.any():
                found.append((active[fit], other[fit]))
        left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        # the same two documents may meet in several lists of the table
        names, number = np.unique(cols["doc"], return_inverse=True)
        code = np.minimum(number[left], number[right]) * len(names) + np.maximum(number[left], number[right])
        once = np.sort(np.unique(code, return_index=True)[1])
        once = once[_may_link(n, parity, left[once], right[once])] if len(once) else once
        rest = once[:0]
        if first_only:
            chosen = np.union1d(np.unique(left[once], return_index=True)[1], np.unique(right[once], return_index=True)[1])
            once, rest = once[chosen], np.delete(once, chosen)
        rest = np.unique(cols["shingle"][left[rest]])
        none = pa.nulls(len(rest), pa.int64())
        pair = [pa.array(names[part]) for part in np.divmod(code[once], len(names))]
        columns = [pa.concat_arrays([part, none]) for part in pair] + [pa.concat_arrays([pa.nulls(len(once), pa.int64()), pa.array(rest)])]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "shingle"])


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, the set's signature sig_a, sig_b, and the component's name in group."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summaries = scratch.keep(docs.mapInArrow(_summaries, _SUMMARY), "summaries")
    sketch = spark.sparkContext.broadcast(_length_sketch(spark, summaries))
    rows = summaries.where("NOT repeat")
    sets = rows.where("doc_id IS NOT NULL AND n > 0")
    several = sets.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("sig_a", "sig_b")])
    several = several.where("min_sig_a <> max_sig_a OR min_sig_b <> max_sig_b").select("doc_id", F.lit(True).alias("shared"))
    leads = sets.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("parity").alias("parity"))
    leads = leads.join(several, "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    node = F.when(F.col("shared"), F.col("sig_a").bitwiseXOR(F.shiftright("sig_b", 1))).otherwise(F.col("doc_id"))
    leads = scratch.keep(leads.withColumn("node", node), "leads")
    info = leads.select(F.col("node").alias("doc"), "n", "parity")
    searching = docs.join(leads.select("doc_id", "shared").distinct(), "doc_id")

    by_size = Window.partitionBy("shingle").orderBy("n", "doc")
    lists = searching.mapInArrow(lambda it: _short_lists(sketch, it), "shingle long, doc long, n int")
    # sizes ascend, so a document whose neighbours don't fit its size has no partner in the list
    lists = lists.withColumns({"p": F.lag("doc").over(by_size), "pn": F.lag("n").over(by_size), "nn": F.lead("n").over(by_size)})
    lists = scratch.keep(lists.where("5 * pn >= 4 * n OR 5 * n >= 4 * nn").drop("nn"), "lists")

    # neighbours in a list
    pairs = lists.where("p <> doc AND 5 * pn >= 4 * n").select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(info.select(F.col("doc").alias(side), F.col("parity").alias(f"parity_{side}"), F.col("n").alias(f"n_{side}")), side)
    pairs = scratch.keep(pairs.mapInArrow(_bitmap_bound, "a long, b long"), "candidates")
    links = scratch.keep(_check(pairs, leads, docs), "links")
    found = scratch.keep(components(scratch, links), "components")

    # lists that still hold more than one component: first one partner for each row, then the lists that this cut short
    for first_only in (True, False):
        met = _open_blocks(lists, found, info).mapInArrow(functools.partial(_block_pairs, first_only), "a long, b long, shingle long")
        met = scratch.keep(met, "candidates")
        pairs = met.where("shingle IS NULL").select("a", "b").distinct()
        links = links.union(scratch.keep(_check(pairs, leads, docs), "links"))
        found = scratch.keep(components(scratch, links), "components")
        lists = lists.join(met.where("shingle IS NOT NULL").select("shingle").distinct(), "shingle", "left_semi")

    whole = found.join(leads.select("node", "doc_id"), "node")
    lowest = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = leads.join(whole.select("node", "component"), "node", "left").join(lowest, "component", "left")
    named = named.select("sig_a", "sig_b", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("group"))
    # an empty set meets nothing: its signature is no key
    key = [F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("sig_a", "sig_b")]
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), *key).join(named, ["sig_a", "sig_b"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "sig_a", "sig_b", "group")


def _open_blocks(lists: DataFrame, found: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, dealt so that any two rows of a list meet in one block of bounded size."""
    tagged = lists.select("shingle", "doc", "n").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")
    open_lists = tagged.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("rows")).where("low < high").select("shingle", blocks)
    dealt = tagged.join(open_lists, "shingle").join(info.select("doc", "parity"), "doc").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("shingle", "doc", "n", "component", "parity", block.alias("block"), side.alias("side"))
    return dealt.repartition("shingle", "block").sortWithinPartitions("shingle", "block", "n", "doc")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the one with its smallest doc_id. Empty texts and rows without an id all stay.

    Ids that stand in one row are filtered by id. Only rows of a repeated id are told apart by their sets as well.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.keep(jaccard_join(docs), "rows")
    counts = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"), F.max("component_id").alias("component_id"))
    counts = scratch.keep(counts, "ids")
    stay = docs.join(counts.where("rows = 1 AND (n = 0 OR doc_id = component_id)").select("doc_id"), "doc_id", "left_semi")
    stay = stay.unionByName(docs.where("doc_id IS NULL"))
    repeated = counts.where("rows > 1").select("doc_id")
    if repeated.isEmpty():
        return stay

    def sign(batch: pa.RecordBatch) -> dict[str, list]:
        signed = [(len(own), *_signature(own)) if len(own) else (0, None, None) for _, own in _each_set(batch["text"])]
        return dict(zip((size, a, b), zip(*signed)))

    taken = {c.lower() for c in docs.columns}
    size, a, b = ("_" * max(map(len, taken)) + c for c in ("n", "sig_a", "sig_b"))
    several = add_columns(docs.join(repeated, "doc_id", "left_semi"), f"{size} long, {a} long, {b} long", sign)
    lead = found.join(repeated, "doc_id", "left_semi").where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id", "group").agg(F.min(F.struct(F.col("sig_a").alias(a), F.col("sig_b").alias(b))).alias("lead")).select("doc_id", "lead.*")
    chosen = several.where(F.col(size) > 0).join(lead, ["doc_id", a, b], "left_semi").dropDuplicates(["doc_id", a, b])
    return stay.unionByName(chosen.select(docs.columns)).unionByName(several.where(F.col(size) == 0).select(docs.columns))


def _check(pairs: DataFrame, leads: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the overlap."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = leads.join(named, "node", "left_semi").select("doc_id", "shared").distinct()
    sets = docs.join(wanted, "doc_id").mapInArrow(_sets, "doc long, shingles binary")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.mapInArrow(_reaches_overlap, "a long, b long").distinct()
