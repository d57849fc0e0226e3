"""Order-dependent box algorithms: one-to-one assignment and suppression.

Images of a checked size are packed into one array per image and folded inside
the JVM, so a whole table needs one shuffle per side on ``image_id``.  An image
with more boxes than ``limit`` goes through batches of bounded size (``crowded``).
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameops.functions.geometry import CORNERS, has_area
from frameops.operators.crowded import assign_in_batches, suppress_in_batches
from frameops.operators.rounds import assign_images, cluster_images, suppress_images
from frameops.operators.scale import hot_keys, split_hot

# Boxes of one image handled by a single fold.
IMAGE_LIMIT = 1_000
# Side of a grid cell for images above the limit, in pixels.
CELL = 256

_INTER = (
    "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    " * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
)


def _overlap_sql(a: str, b: str) -> str:
    return f"({_INTER.format(a=a, b=b)}) > 0"


def _iou_sql(a: str, b: str) -> str:
    inter = _INTER.format(a=a, b=b)
    return f"if({inter} > 0, ({inter}) / ({a}.area + {b}.area - {inter}), 0.0D)"


def _packed(df: DataFrame, keys: Sequence[str], fields: Sequence[Column], name: str) -> DataFrame:
    """One sorted array of structs per key, partitioned on the image alone."""
    return (
        df.repartition("image_id")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    )


def _area() -> Column:
    return (
        F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    ).alias("area")


def grid_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """Overlapping pairs (l_*, r_*) of two prefixed box tables that share ``keys``.

    A pair is met in every cell both boxes touch and kept only in the cell that
    holds the corner of their intersection, so no distinct is needed.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        def span(low: str, high: str) -> Column:
            return F.sequence(F.floor(F.col(p + low) / cell), F.floor(F.col(p + high) / cell))

        df = df.filter(has_area(p)).withColumn("cx", F.explode(span("x1", "x2")))
        return df.withColumn("cy", F.explode(span("y1", "y2")))

    pairs = cells(left, "l_").join(cells(right, "r_"), [*keys, "cx", "cy"])
    x0, y0 = F.greatest("l_x1", "r_x1"), F.greatest("l_y1", "r_y1")
    inside = (x0 < F.least("l_x2", "r_x2")) & (y0 < F.least("l_y2", "r_y2"))
    home = (F.floor(x0 / cell) == F.col("cx")) & (F.floor(y0 / cell) == F.col("cy"))
    return pairs.filter(inside & home).drop("cx", "cy")


def assign(
    seekers: DataFrame,
    targets: DataFrame,
    threshold: float,
    order: Sequence[Column],
    seeker_id: str,
    target_id: str,
    extra: Sequence[str] = (),
    limit: int = IMAGE_LIMIT,
    keep: Sequence[str] | None = None,
    notes: DataFrame | None = None,
) -> DataFrame:
    """Seekers take, in ``order``, the free target of highest IoU (lowest id on ties).

    A seeker whose best free target is below ``threshold`` takes nothing.
    ``extra`` are further seeker keys (a model name, a grid point).  Returns
    seeker columns (those of ``keep``, else all) plus ``target`` and ``best_iou``.

    ``notes`` has one row per image, with a long ``note``: it is added to the image's seekers, and seekers of other images
    are left out, as by a join.
    """
    keep = list(seekers.columns if keep is None else keep)
    hot = hot_keys(seekers.select("image_id").union(targets.select("image_id")), ["image_id"], limit)
    cold_s, hot_s = (seekers, None) if hot is None else split_hot(seekers, ["image_id"], hot)
    cold_t, hot_t = (targets, None) if hot is None else split_hot(targets, ["image_id"], hot)
    types = [targets.schema[c].dataType.typeName() for c in CORNERS] + [seekers.schema[c].dataType.typeName() for c in CORNERS]
    parts = []
    if set(types) <= {"integer", "long"}:
        parts.append(_assign_in_rounds(cold_s, cold_t, threshold, order, seeker_id, target_id, extra, keep, notes))
    else:
        parts.append(_noted(_assign_in_arrays(cold_s, cold_t, threshold, order, seeker_id, target_id, extra), keep, notes))
    if hot is not None:
        parts.append(_noted(assign_in_batches(hot_s, hot_t, threshold, order, seeker_id, target_id, extra), keep, notes))
    return parts[0] if hot is None else parts[0].unionByName(parts[1])


def _noted(rows: DataFrame, keep: list[str], notes: DataFrame | None) -> DataFrame:
    if notes is None:
        return rows.select(*keep, "target", "best_iou")
    return rows.join(notes.select("image_id", "note"), "image_id").select(*keep, "target", "best_iou", "note")


def _assign_in_rounds(seekers, targets, threshold, order, seeker_id, target_id, extra, keep, notes) -> DataFrame:
    """Both sides meet in one shuffle on the image; a task walks its images in rounds (``rounds``).

    Only columns that are used are shuffled, each once: what is derived from them is derived behind the shuffle.
    """
    extra, schema = list(extra), seekers.schema
    left = seekers.withColumn("__side", F.lit(1))
    # a null image is no image of the truth
    right = targets.filter(F.col("image_id").isNotNull()).select("image_id", *CORNERS, F.lit(0).alias("__side"), F.col(target_id).alias("__target"))
    rows = left.unionByName(right, allowMissingColumns=True)
    if notes is not None:
        rows = rows.unionByName(notes.select("image_id", F.lit(-1).alias("__side"), F.col("note").cast("long").alias("__note")), allowMissingColumns=True)
    rows, wide = rows.repartition("image_id"), rows.schema
    groups, ranks = [f"__e{i}" for i in range(len(extra))], [f"__k{i}" for i in range(len(order))]
    rows = rows.withColumns({**{g: F.col(e) for g, e in zip(groups, extra)}, **dict(zip(ranks, order)), "__id": F.col(seeker_id)})
    rows = rows.sortWithinPartitions("image_id", "__side", *groups, *ranks, "__id", "__target")
    payload, held = {c: f"__p_{c}" for c in keep}, [] if notes is None else ["note"]
    # the other side may have widened a column, whose values there need not fit
    own = lambda c: F.col(c) if wide[c].dataType == schema[c].dataType else F.when(F.col("__side") == 1, F.col(c).cast(schema[c].dataType))
    rows = rows.select("image_id", F.col("__side").alias("side"), F.col("__target").alias("target"), *[F.col(c).cast("long").alias(c) for c in CORNERS], *groups,
                       *[F.col(f"__{n}").alias(n) for n in held], *[own(c).alias(p) for c, p in payload.items()])
    out_schema = T.StructType([*[T.StructField(p, schema[c].dataType) for c, p in payload.items()],
                               T.StructField("target", targets.schema[target_id].dataType), T.StructField("best_iou", T.DoubleType()),
                               *[T.StructField(n, T.LongType()) for n in held]])
    names, noted = list(payload.values()), notes is not None
    out = rows.mapInArrow(lambda it: assign_images(groups, names, threshold, it, noted), out_schema)
    return out.select(*[F.col(p).alias(c) for c, p in payload.items()], "target", "best_iou", *held)


def _assign_in_arrays(seekers, targets, threshold, order, seeker_id, target_id, extra) -> DataFrame:
    columns = seekers.columns
    ranks = [o.alias(f"k{i}") for i, o in enumerate(order)]
    keys = ["image_id", *extra]
    payload = [c for c in columns if c not in keys]
    left = _packed(
        seekers, keys, [*ranks, F.col(seeker_id).alias("id"), *CORNERS, _area(), F.struct(*payload).alias("row")], "s"
    )
    right = _packed(targets, ["image_id"], [F.col(target_id).alias("id"), *CORNERS, _area()], "t")
    id_type = targets.schema[target_id].dataType.simpleString()
    row_type = seekers.select(F.struct(*payload).alias("row")).schema["row"].dataType.simpleString()
    best = (
        "array_max(transform(filter(transform(coalesce(t, array()), (g, i) -> struct(g, i)), "
        f"c -> {_overlap_sql('s1', 'c.g')} and not array_contains(acc.taken, c.i)), "
        f"c -> named_struct('iou', {_iou_sql('s1', 'c.g')}, 'neg', -c.i, 'id', c.g.id)))"
    )
    fold = f"""
        aggregate(
          s,
          named_struct(
            'taken', cast(array() as array<int>),
            'out', cast(array() as array<struct<row:{row_type},target:{id_type},best_iou:double>>)),
          (acc, s1) -> transform(array({best}), b -> named_struct(
            'taken', if(b.iou >= {threshold!r}D, concat(acc.taken, array(-b.neg)), acc.taken),
            'out', concat(acc.out, array(named_struct(
                'row', s1.row,
                'target', if(b.iou >= {threshold!r}D, b.id, cast(null as {id_type})),
                'best_iou', coalesce(b.iou, 0.0D))))))[0],
          acc -> acc.out)
    """
    out = left.join(right, "image_id", "left").select(*keys, F.inline(F.expr(fold)))
    return out.select(
        *[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in columns], "target", "best_iou"
    )


def clustered(
    boxes: DataFrame,
    threshold: float,
    order: Sequence[Column],
    box_id: str,
    floor: float,
    extra: Sequence[str] = (),
    limit: int = IMAGE_LIMIT,
) -> DataFrame:
    """A row per seed of ``suppress``: ``cluster_id``, sums of the corners weighted by score (``floor`` at least) and of the
    weights (``s_x1`` to ``s_w``), highest score, ``members``, and the highest score by source in order of names.
    """
    hot = hot_keys(boxes, ["image_id"], limit)
    whole = {boxes.schema[c].dataType.typeName() for c in CORNERS} <= {"integer", "long"}
    if not whole:
        return _summed(suppress(boxes, threshold, order, box_id, extra, limit=limit), floor, extra)
    cold, large = (boxes, None) if hot is None else split_hot(boxes, ["image_id"], hot)
    rows, keys = _in_visiting_order(cold, order, box_id, extra, None, {"source": "source", "score": "score"})
    names = dict(zip(["image_id", *extra, box_id], ["image_id", *keys, "id"]))
    number = T.DoubleType()
    schema = T.StructType([*[T.StructField(n, boxes.schema[c].dataType) for c, n in names.items()], *[T.StructField(f"s_{c}", number) for c in (*CORNERS, "w")],
                           T.StructField("score", number), T.StructField("members", T.LongType()), T.StructField("source_scores", T.MapType(T.StringType(), number))])
    out = rows.mapInArrow(lambda it: cluster_images(keys, floor, threshold, it), schema)
    out = out.withColumnsRenamed({**dict(zip(keys, extra)), "id": "cluster_id"})
    return out if large is None else out.unionByName(_summed(suppress_in_batches(large, threshold, order, box_id, extra, None), floor, extra))


def _summed(seeded: DataFrame, floor: float, extra: Sequence[str]) -> DataFrame:
    weight = F.greatest(F.col("score"), F.lit(floor))
    # one row per (cluster, source) first: a cluster of many copies stays small and the passes above run once
    per_source = seeded.groupBy("image_id", *extra, F.col("seed").alias("cluster_id"), "source").agg(
        *[F.sum(F.col(c) * weight).alias(f"s_{c}") for c in CORNERS], F.sum(weight).alias("s_w"),
        F.max("score").alias("source_score"), F.count(F.lit(1)).alias("n"))
    scores = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "source_score"))))
    return per_source.groupBy("image_id", *extra, "cluster_id").agg(
        *[F.sum(f"s_{c}").alias(f"s_{c}") for c in (*CORNERS, "w")], F.max("source_score").alias("score"),
        F.sum("n").alias("members"), scores.alias("source_scores"))


def suppress(
    boxes: DataFrame,
    threshold: float,
    order: Sequence[Column],
    box_id: str,
    extra: Sequence[str] = (),
    fixed: Column | None = None,
    limit: int = IMAGE_LIMIT,
) -> DataFrame:
    """Greedy suppression: adds ``seed``, the kept box that captured this one.

    Boxes are visited in ``order``; a box with IoU of ``threshold`` or more to a
    kept box is captured by the first such box, otherwise it is kept (its seed
    is itself).  ``fixed`` rows are always kept and must come first in ``order``.
    """
    hot = hot_keys(boxes, ["image_id"], limit)
    if hot is None:
        return _suppress_folded(boxes, threshold, order, box_id, extra, fixed)
    cold, large = split_hot(boxes, ["image_id"], hot)
    folded = _suppress_folded(cold, threshold, order, box_id, extra, fixed)
    return folded.unionByName(suppress_in_batches(large, threshold, order, box_id, extra, fixed))


def _suppress_folded(boxes, threshold, order, box_id, extra, fixed) -> DataFrame:
    if {boxes.schema[c].dataType.typeName() for c in CORNERS} <= {"integer", "long"}:
        return _suppress_in_rounds(boxes, threshold, order, box_id, extra, fixed)
    return _suppress_in_arrays(boxes, threshold, order, box_id, extra, fixed)


def _in_visiting_order(boxes, order, box_id, extra, fixed, payload: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Boxes as the array rounds take them: one shuffle on the image, and the names of the extra keys."""
    always = F.coalesce(fixed, F.lit(False)) if fixed is not None else F.lit(False)
    keys, ranks = [f"__e{i}" for i in range(len(extra))], [f"__k{i}" for i in range(len(order))]
    rows = boxes.repartition("image_id").select("image_id", *[F.col(e).alias(k) for e, k in zip(extra, keys)], *[o.alias(k) for o, k in zip(order, ranks)], F.col(box_id).alias("id"),
                        *[F.col(c).cast("long").alias(c) for c in CORNERS], always.alias("always"), *[F.col(c).alias(p) for c, p in payload.items()])
    return rows.sortWithinPartitions("image_id", *keys, *ranks, "id", *CORNERS, "always").drop(*ranks), keys


def _suppress_in_rounds(boxes, threshold, order, box_id, extra, fixed) -> DataFrame:
    """A task walks its images in rounds (``rounds``)."""
    payload = {c: f"__p_{c}" for c in boxes.columns}
    rows, keys = _in_visiting_order(boxes, order, box_id, extra, fixed, payload)
    schema = T.StructType([*[T.StructField(payload[f.name], f.dataType) for f in boxes.schema], T.StructField("seed", boxes.schema[box_id].dataType)])
    out = rows.mapInArrow(lambda it: suppress_images(keys, list(payload.values()), threshold, it), schema)
    return out.select(*[F.col(p).alias(c) for c, p in payload.items()], "seed")


def _suppress_in_arrays(boxes, threshold, order, box_id, extra, fixed) -> DataFrame:
    columns, keys = boxes.columns, ["image_id", *extra]
    payload = [c for c in columns if c not in keys]
    ranks = [o.alias(f"k{i}") for i, o in enumerate(order)]
    always = (fixed if fixed is not None else F.lit(False)).alias("always")
    packed = _packed(
        boxes,
        keys,
        [*ranks, F.col(box_id).alias("id"), *CORNERS, _area(), always, F.struct(*payload).alias("row")],
        "s",
    )
    types = {f.name: f.dataType.simpleString() for f in packed.schema["s"].dataType.elementType.fields}
    kept_fields = ["id", *CORNERS, "area"]
    kept_type = ",".join(f"{f}:{types[f]}" for f in kept_fields)
    as_kept = "named_struct(" + ",".join(f"'{f}', s1.{f}" for f in kept_fields) + ")"
    fold = f"""
        aggregate(
          s,
          named_struct(
            'kept', cast(array() as array<struct<{kept_type}>>),
            'out', cast(array() as array<struct<row:{types['row']},seed:{types['id']}>>)),
          (acc, s1) -> transform(
            array(if(s1.always, null, get(filter(acc.kept, k -> {_iou_sql('k', 's1')} >= {threshold!r}D), 0).id)),
            hit -> named_struct(
              'kept', if(hit is null, concat(acc.kept, array({as_kept})), acc.kept),
              'out', concat(acc.out, array(named_struct('row', s1.row, 'seed', coalesce(hit, s1.id))))))[0],
          acc -> acc.out)
    """
    out = packed.select(*keys, F.inline(F.expr(fold)))
    return out.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in columns], "seed")
