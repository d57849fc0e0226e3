"""One-to-one assignment and suppression of boxes on many small images at once.

Images come as runs of rows: truth first, then seekers in visiting order. A batch of images is handled in rounds: in round r the
r-th seeker of every (image, extra keys) meets the free targets of its image, as one array operation over all images. In a round
of suppression the first open box of every (image, extra keys) is kept and captures what it overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of whole images handled together, and pairs of one array operation.
ROWS, PAIRS = 50_000, 2_000_000


def assigned(group: np.ndarray, boxes: np.ndarray, start: np.ndarray, size: np.ndarray, targets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Place of the target each seeker takes (-1: none) and the IoU of its best free target.

    ``group`` numbers the seekers' runs from 0, in visiting order; ``start`` and ``size`` give the targets of each run, which
    are ``targets[start : start + size]`` by id.
    """
    n = len(group)
    took, best = np.full(n, -1), np.zeros(n)
    first = np.searchsorted(group, np.arange(len(start)))
    turn = np.arange(n) - first[group]
    # every run has its own set of free targets
    offset = np.concatenate([[0], np.cumsum(size)])
    free = np.ones(offset[-1], bool)
    by_turn = np.argsort(turn, kind="stable")
    low = 0
    for high in np.cumsum(np.bincount(turn)) if n else ():
        now = by_turn[low:high]
        low = high
        now = now[size[group[now]] > 0]
        ends = np.cumsum(size[group[now]])
        at = 0
        while at < len(now):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            seekers, at = now[at:stop], stop
            count = size[group[seekers]]
            begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            inside = np.arange(count.sum()) - np.repeat(begin, count)
            runs = np.repeat(group[seekers], count)
            t, a = targets[start[runs] + inside], np.repeat(boxes[seekers], count, axis=0)
            # a null corner is skipped, as by least and greatest
            wide = np.fmax(0, np.fmin(a[:, 2], t[:, 2]) - np.fmax(a[:, 0], t[:, 0]))
            inter = wide * np.fmax(0, np.fmin(a[:, 3], t[:, 3]) - np.fmax(a[:, 1], t[:, 1]))
            union = _area(a) + _area(t) - inter
            value = np.where((inter > 0) & free[offset[runs] + inside], inter / np.where(inter > 0, union, 1), 0.0)
            top = np.maximum.reduceat(value, begin)
            # the lowest id on ties
            place = np.minimum.reduceat(np.where(value == np.repeat(top, count), inside, len(targets)), begin)
            best[seekers] = top
            won = (top >= threshold) & (top > 0)
            took[seekers[won]] = start[group[seekers[won]]] + place[won]
            free[offset[group[seekers[won]]] + place[won]] = False
    return took, best


def _area(b: np.ndarray) -> np.ndarray:
    return np.fmax(0, b[:, 2] - b[:, 0]) * np.fmax(0, b[:, 3] - b[:, 1])


def changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Rows that differ from the one before in some column; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in names:
        column = table[name].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def suppressed(group: np.ndarray, boxes: np.ndarray, always: np.ndarray, named: np.ndarray, threshold: float) -> np.ndarray:
    """Place of the kept box that captures each box, its own when it is kept.

    ``group`` numbers the runs of boxes from 0, in visiting order. Boxes with ``always`` are kept; a kept box that is not
    ``named`` captures nothing, what it would capture is kept.
    """
    seed = np.arange(len(group))
    area, left, free = _area(boxes), seed, ~always
    while len(left):
        runs = group[left]
        lead = np.flatnonzero(np.diff(runs, prepend=-1))
        size = np.diff(np.append(lead, len(left)))
        by = np.repeat(left[lead], size)
        a, b = boxes[by], boxes[left]
        # a null corner is skipped, as by least and greatest
        inter = np.fmax(0, np.fmin(a[:, 2], b[:, 2]) - np.fmax(a[:, 0], b[:, 0])) * np.fmax(0, np.fmin(a[:, 3], b[:, 3]) - np.fmax(a[:, 1], b[:, 1]))
        over = np.where(inter > 0, inter / np.where(inter > 0, area[by] + area[left] - inter, 1), 0.0) >= threshold
        over[lead] = False
        over &= free[left]
        free[left[over & ~named[by]]] = False
        caught = over & named[by]
        seed[left[caught]] = by[caught]
        stays = ~caught
        stays[lead] = False
        left = left[stays]
    return seed


def whole_images(batches: Iterator[pa.RecordBatch], keys: Sequence[str] = ("image_id",)) -> Iterator[pa.Table]:
    """Tables of about ``ROWS`` rows that hold whole images, or whole groups of other ``keys``."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        # the last group may go on
        cut = int(np.flatnonzero(changes(table, keys))[-1])
        yield table.slice(0, cut)
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def suppress_images(extra: list[str], keep: list[str], threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes with ``seed``; rows have image_id, the extra keys, id, corners, always and ``keep``, in visiting order."""
    for table in whole_images(batches):
        if not table.num_rows:
            continue
        ids = table["id"].combine_chunks()
        boxes = np.stack([table[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
        group = np.cumsum(changes(table, ["image_id", *extra])) - 1
        always, named = table["always"].to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False)
        seed = ids.take(pa.array(suppressed(group, boxes, always, named, threshold)))
        yield from table.select(keep).append_column("seed", seed).combine_chunks().to_batches()


def _grouped(values: np.ndarray, null: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Largest value of each of ``n`` groups, null where all are; a NaN is larger than any number."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, of[~null], values[~null])
    return pa.array(top, mask=np.bincount(of[~null], minlength=n) == 0)


def cluster_images(extra: list[str], floor: float, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per cluster: image, extra keys, id of the seed, weighted sums of corners and weights, score, members, scores by source.

    Rows come as in ``suppress_images``, with source and score.
    """
    corners = ["x1", "y1", "x2", "y2"]
    for table in whole_images(batches):
        if not table.num_rows:
            continue
        ids = table["id"].combine_chunks()
        boxes = np.stack([table[c].to_numpy() for c in corners], 1)
        group = np.cumsum(changes(table, ["image_id", *extra])) - 1
        always, named = np.zeros(len(group), bool), pc.is_valid(ids).to_numpy(zero_copy_only=False)
        leads, of = np.unique(suppressed(group, boxes, always, named, threshold), return_inverse=True)
        n = len(leads)
        score, null = table["score"].to_numpy().astype(np.float64), pc.is_null(table["score"]).to_numpy()
        weight = np.where(null, floor, np.maximum(score, floor))
        columns = {name: table[name].combine_chunks().take(pa.array(leads)) for name in ["image_id", *extra, "id"]}
        for i, c in enumerate(corners):
            there = pc.is_valid(table[c]).to_numpy()
            total = np.bincount(of[there], boxes[there, i] * weight[there], n)
            columns[f"s_{c}"] = pa.array(total, mask=np.bincount(of[there], minlength=n) == 0)
        columns |= {"s_w": pa.array(np.bincount(of, weight, n)), "score": _grouped(score, null, of, n), "members": pa.array(np.bincount(of, minlength=n))}
        sources = table["source"].combine_chunks().dictionary_encode()
        place = np.argsort(pc.sort_indices(sources.dictionary).to_numpy())
        # a cluster's sources in order of their names
        pairs, pair_of = np.unique(of * len(place) + place[sources.indices.to_numpy()], return_inverse=True)
        names = sources.dictionary.take(pc.sort_indices(sources.dictionary)).take(pa.array(pairs % len(place)))
        offsets = np.searchsorted(pairs // len(place), np.arange(n + 1)).astype(np.int32)
        columns["source_scores"] = pa.MapArray.from_arrays(pa.array(offsets), names, _grouped(score, null, pair_of, len(pairs)))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def assign_images(extra: list[str], keep: list[str], threshold: float, batches: Iterator[pa.RecordBatch], noted: bool = False) -> Iterator[pa.RecordBatch]:
    """Seekers with ``target`` and ``best_iou``; rows have image_id, side (-1: a note, 0: truth), the extra keys, id, corners and ``keep``.

    When ``noted``, seekers carry the note of their image, and those of images without one are left out.
    """
    corners = ["x1", "y1", "x2", "y2"]

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        image = np.cumsum(changes(table, ["image_id"])) - 1
        if noted:
            told = np.flatnonzero(table["side"].to_numpy() == -1)
            # a null image has no note
            told = told[table["image_id"].combine_chunks().take(pa.array(told)).is_valid().to_numpy(zero_copy_only=False)]
            place = np.full(image[-1] + 1 if len(image) else 0, -1)
            place[image[told]] = told
            rows = np.flatnonzero((place[image] >= 0) & (table["side"].to_numpy() >= 0))
            note = table["note"].combine_chunks().take(pa.array(place[image[rows]]))
            table = table.take(pa.array(rows)).set_column(table.schema.get_field_index("note"), "note", note)
            image = image[rows]
        seeking = table["side"].to_numpy() == 1
        seekers = table.filter(pa.array(seeking))
        if not seekers.num_rows:
            return
        boxes = np.stack([table[c].to_numpy() for c in corners], 1)
        group = np.cumsum(changes(seekers, ["image_id", *extra])) - 1
        of_group = image[seeking][np.flatnonzero(np.diff(group, prepend=-1))]
        owner = image[~seeking]
        start, end = np.searchsorted(owner, of_group), np.searchsorted(owner, of_group, "right")
        took, best = assigned(group, boxes[seeking], start, end - start, boxes[~seeking], threshold)
        ids = table["target"].combine_chunks().filter(pa.array(~seeking))
        target = ids.take(pa.array(took, mask=took < 0))
        out = seekers.select(keep).append_column("target", target).append_column("best_iou", pa.array(best))
        if noted:
            out = out.append_column("note", seekers["note"])
        yield from out.combine_chunks().to_batches()

    for table in whole_images(batches):
        yield from solved(table)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the first place of each set) after the sets of ``a`` and ``b`` fall together."""
    a, b = label[a], label[b]
    while len(open_ := np.flatnonzero(a != b)):
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label = above
        a, b = label[a], label[b]
    return label


def linked(group: np.ndarray, cx: np.ndarray, cy: np.ndarray, link: np.ndarray) -> np.ndarray:
    """First place of the set of each point; points of a run link when both coordinates lie within ``link``.

    ``group`` numbers the runs, whose points come by ``cx``: in round k every point meets the k-th after it, as long as that is near.
    """
    label, left, k = np.arange(len(group)), np.arange(len(group)), 1
    while len(left):
        left = left[: np.searchsorted(left, len(group) - k)]
        left = left[(group[left + k] == group[left]) & (cx[left + k] - cx[left] <= link[left])]
        near = left[np.abs(cy[left + k] - cy[left]) <= link[left]]
        label = _merge(label, near, near + k)
        k += 1
    return label


def linked_images(link_frac: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set of linked boxes: image, its size, members and outer corners.

    Rows have image_id, side (0: the frame, with width and height; 1: a box, with its corners) and come by image, side and centre.
    """
    corners = {"x1": np.minimum, "y1": np.minimum, "x2": np.maximum, "y2": np.maximum}
    for table in whole_images(batches):
        image = np.cumsum(changes(table, ["image_id"])) - 1
        side = table["side"].to_numpy()
        frames = np.flatnonzero(side == 0)
        known, at = np.unique(image[frames], return_index=True)
        frame = np.full(len(np.unique(image)), -1)
        frame[known] = frames[at]
        rows = np.flatnonzero((side == 1) & (frame[image] >= 0))
        if not len(rows):
            continue
        boxes = {c: table[c].combine_chunks().take(pa.array(rows)).to_numpy() for c in corners}
        own = frame[image[rows]]
        frames = table.select(["width", "height"]).take(pa.array(own))
        link = link_frac * np.maximum(frames["width"].to_numpy(), frames["height"].to_numpy())
        label = linked(image[rows], (boxes["x1"] + boxes["x2"]) / 2.0, (boxes["y1"] + boxes["y2"]) / 2.0, link)
        order = np.argsort(label, kind="stable")
        lead = np.flatnonzero(np.diff(label[order], prepend=-1))
        firsts = pa.array(label[order][lead])
        columns = {"image_id": table["image_id"].combine_chunks().take(pa.array(rows)).take(firsts)}
        columns |= {c: frames[c].combine_chunks().take(firsts) for c in ("width", "height")}
        columns["members"] = pa.array(np.diff(np.append(lead, len(order))))
        columns |= {name: pa.array(fold.reduceat(boxes[c][order], lead)) for name, (c, fold) in zip(("lx", "ly", "hx", "hy"), corners.items())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def near_weights(group: np.ndarray, boxes: np.ndarray, weight: np.ndarray, side: np.ndarray, across: np.ndarray, threshold: float) -> np.ndarray:
    """Per run, the sum of the products of weights over pairs of boxes with IoU of ``threshold`` or more.

    ``group`` numbers the runs, whose boxes come by their left side: in round k every box meets the k-th after it, as long as that
    begins before it ends. Runs ``across`` two blocks count pairs of different ``side`` only.
    """
    area, total = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), np.zeros(group[-1] + 1)
    left, k = np.arange(len(group)), 1
    while len(left):
        left = left[: np.searchsorted(left, len(group) - k)]
        left = left[(group[left + k] == group[left]) & (boxes[left + k, 0] < boxes[left, 2])]
        a, b = boxes[left], boxes[left + k]
        inter = np.maximum(0, np.minimum(a[:, 2], b[:, 2]) - b[:, 0]) * np.maximum(0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
        over = (inter > 0) & (inter / np.where(inter > 0, area[left] + area[left + k] - inter, 1) >= threshold)
        over &= ~across[left] | (side[left] != side[left + k])
        hit = left[over]
        total += np.bincount(group[hit], weight[hit] * weight[hit + k], len(total))
        k += 1
    return total


def count_tiles(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted pairs of each tile: all of a block with itself, or of two blocks with each other. Rows come by tile and x1."""
    keys = ["image_id", "low", "high"]
    for table in whole_images(batches, keys):
        if not table.num_rows:
            continue
        new = changes(table, keys)
        boxes = np.stack([table[c].to_numpy().astype(np.float64) for c in ("x1", "y1", "x2", "y2")], 1)
        across = table["low"].to_numpy() != table["high"].to_numpy()
        pairs = near_weights(np.cumsum(new) - 1, boxes, table["w"].to_numpy().astype(np.float64), table["side"].to_numpy(), across, threshold)
        images = table["image_id"].combine_chunks().take(pa.array(np.flatnonzero(new)))
        yield pa.RecordBatch.from_arrays([images, pa.array(np.rint(pairs).astype(np.int64))], names=["image_id", "pairs"])
