"""Deterministic sampling and splits (P02-P20, P22).  Order always comes from P01."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameops.functions.labels import condition_filter, condition_score, stable_order
from frameops.lineage import cut
from frameops.operators.scale import GROUP_LIMIT, broadcast_if_small, null_safe_join, running_totals, top_k
from frameops.operators.windows import keep_one



def _by_hash(seed: int, key: str) -> list[Column]:
    return [stable_order(seed, F.col(key)), F.col(key)]


def quotas(df: DataFrame, strata: Sequence[str], n: int, rows: Column | None = None) -> DataFrame:
    """Rows per stratum for a sample of ``n``: floors, then the largest remainders (bigger stratum on ties).

    ``rows`` is the number of rows that a row of ``df`` stands for, one by default.
    """
    sizes = df.groupBy(*strata).agg(F.sum(F.lit(1) if rows is None else rows).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    exact = F.col("size") * n / F.col("total")
    out = sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.floor(exact)).withColumn("part", exact - F.col("quota"))
    # one row per stratum from here on
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("part").desc(), F.col("size").desc(), *[F.col(s) for s in strata]))
    missing = F.lit(n) - F.sum("quota").over(everything)
    out = out.withColumns({"missing": missing, "place": place})
    extra = F.when(F.col("place") <= F.col("missing"), 1).otherwise(0)
    return out.select(*strata, "size", (F.col("quota") + extra).alias("quota"))


def stratified_sample(df: DataFrame, key: str, strata: Sequence[str], n: int | str, seed: int = 42) -> DataFrame:
    """Proportional sample of exactly ``n`` rows; "all" passes through.

    A pass counts rows by stratum and first digits of their hash. Only rows up to the digits that fill a stratum's quota are
    sorted, so a ``df`` that is large, such as a join, is neither sorted nor shuffled.
    """
    if n == "all":
        return df
    if not strata:
        available = df.count()
        if n > available:
            raise ValueError(f"requested {n} rows, {available} available")
        return df.orderBy(*_by_hash(seed, key)).limit(n)
    digits = F.substring(stable_order(seed, F.col(key)), 1, 3)
    counted = cut(df.groupBy(*strata, digits.alias("__digits")).agg(F.count(F.lit(1)).alias("__rows")))
    available = counted.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    if n > available:
        raise ValueError(f"requested {n} rows, {available} available")
    share = quotas(counted, strata, n, F.col("__rows")).select(*[F.col(s).alias(f"__{s}") for s in strata], "quota")
    same = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata]
    before = Window.partitionBy(*strata).orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)
    needed = counted.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).join(share, same)
    bound = needed.filter(F.col("__before") < F.col("quota")).groupBy(*share.columns).agg(F.max("__digits").alias("__bound"))
    near = df.join(broadcast_if_small(cut(bound)), same).filter(digits <= F.col("__bound"))
    ranked = top_k(near, strata, _by_hash(seed, key), n, "__rank")
    return ranked.filter(F.col("__rank") <= F.col("quota")).select(*df.columns)


def one_per_group(df: DataFrame, key: str, groups: Sequence[str], seed: int = 42) -> DataFrame:
    """First row per group in hash order."""
    return keep_one(df, groups, _by_hash(seed, key))


def anchored_pool(df: DataFrame, key: str, groups: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """One row per group, then hash order up to ``size``."""
    anchors = one_per_group(df, key, groups, seed)
    rest = df.join(anchors.select(key), key, "left_anti")
    missing = max(size - anchors.count(), 0)
    return anchors.unionByName(rest.orderBy(*_by_hash(seed, key)).limit(missing))


def diverse_pool(df: DataFrame, key: str, groups: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """First two per group by key, then by hash of the group and hash of the key."""
    anchors = top_k(df, groups, [F.col(key)], 2, "__rank").drop("__rank")
    rest = df.join(anchors.select(key), key, "left_anti")
    group_key = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups])
    order = [stable_order(seed, group_key), *_by_hash(seed, key)]
    missing = max(size - anchors.count(), 0)
    return anchors.unionByName(rest.orderBy(*order).limit(missing))


def cell_sample(df: DataFrame, key: str, dims: Sequence[str], per_cell: int, n: int, seed: int = 42) -> DataFrame:
    """Up to ``per_cell`` rows per cell of the dimensions, then hash order, exactly ``n``."""
    first = top_k(df, dims, _by_hash(seed, key), per_cell, "__rank").select(key, F.lit(0).alias("__tier"))
    tiered = df.join(first, key, "left").fillna(1, ["__tier"])
    out = tiered.orderBy("__tier", *_by_hash(seed, key)).limit(n).drop("__tier")
    found = out.count()
    if found != n:
        raise ValueError(f"requested {n} rows, found {found}")
    return out


def condition_quota(df: DataFrame, key: str, matches: str, labels: Sequence[str], per_label: int, n: int,
                    groups: Sequence[str], seed: int = 42) -> DataFrame:
    """``per_label`` unused rows per label in order, then anchors, rows with a match, any rows; exactly ``n``.

    One pass ranks the rows of each label; only the first labels x per_label of
    a label can ever be taken, so the order-dependent part runs on that bounded
    list.
    """
    reach = len(labels) * per_label
    exploded = df.select(key, F.explode(matches).alias("label")).filter(F.col("label").isin(*labels))
    candidates = top_k(exploded, ["label"], _by_hash(seed, key), reach, "place").orderBy("label", "place").collect()
    by_label: dict[str, list] = {}
    for row in candidates:
        by_label.setdefault(row["label"], []).append(row[key])
    taken: dict = {}
    for label in labels:
        free = [k for k in by_label.get(label, []) if k not in taken][:per_label]
        if len(by_label.get(label, [])) < per_label:
            raise ValueError(f"label {label} has fewer than {per_label} rows")
        taken.update({k: label for k in free})
    key_type = df.schema[key].dataType.simpleString()
    picked = df.sparkSession.createDataFrame(list(taken.items()), f"{key} {key_type}, condition_label string")
    rest = df.join(F.broadcast(picked.select(key)), key, "left_anti")
    anchors = one_per_group(df, key, groups, seed).select(key, F.lit(True).alias("__anchor"))
    tier = F.when(F.col("__anchor"), 0).when(F.size(matches) > 0, 1).otherwise(2)
    first = F.coalesce(F.get(F.col(matches), F.lit(0)), F.when(F.col("no_face_flag"), "no_face"), F.lit("motion_blur"))
    filler = rest.join(anchors, key, "left").orderBy(tier, *_by_hash(seed, key)).limit(max(n - len(taken), 0))
    filler = filler.select(key, first.alias("condition_label"))
    return picked.unionByName(filler).withColumn("selection_seed", F.lit(seed))


def candidate_bank(df: DataFrame, key: str, condition: str, top: int = 50, seed: int = 42,
                   groups: Sequence[str] = ("day_id", "camera_stream_id")) -> DataFrame:
    """Ranked bank of one condition; until half is filled no group repeats.

    The best row of each group is a "first" row.  Firsts fill the first half;
    then everything after the last of them in rank order; then the repeats that
    were passed over.  Every step is a bounded top list.
    """
    # at nine decimals: equal scores stay equal whatever the noise of their sums
    pool = df.filter(condition_filter(condition)).withColumn("candidate_score", F.round(condition_score(condition), 9))
    pool = pool.withColumn("__o", F.struct((-F.col("candidate_score")).alias("s"), stable_order(seed, F.col(key)).alias("h"),
                                           F.col(key).alias("k")))
    firsts = keep_one(pool, groups, [F.col("__o")])
    head = firsts.orderBy("__o").limit(top // 2)
    cut = head.agg(F.when(F.count(F.lit(1)) == top // 2, F.max("__o")).alias("__cut"))
    ranked = pool.join(firsts.select(F.col(key), F.lit(True).alias("__first")), key, "left").crossJoin(F.broadcast(cut))
    open_ended = F.col("__cut").isNull()
    before = open_ended | (F.col("__o") <= F.col("__cut"))
    phase = F.when(before & F.col("__first"), 1).when(before, 3).otherwise(2)
    out = ranked.withColumn("__phase", phase).orderBy("__phase", "__o").limit(top)
    # the bank has at most ``top`` rows
    dense = F.dense_rank().over(Window.orderBy(F.col("candidate_score").desc()))
    out = out.withColumn("__d", dense)
    confidence = F.round(F.col("__d") / F.max("__d").over(Window.partitionBy()), 3)
    return out.withColumn("label_confidence", confidence).withColumn("target_condition", F.lit(condition)).drop(
        "__o", "__first", "__cut", "__phase", "__d")


def quality_bank(df: DataFrame, key: str, column: str, values: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """P10: ``k`` rows per listed value, by hash of column, value and key."""
    rows = df.filter(F.col(column).isin(*values))
    text = F.concat(F.lit(f"{column}:"), F.col(column), F.lit(":"), F.col(key).cast("string"))
    rows = rows.withColumn("candidate_order", stable_order(seed, text))
    out = top_k(rows, [column], [F.col("candidate_order"), F.col(key)], k, "place")
    return out.withColumns({"target_quality_dimension": F.lit(column), "target_quality_value": F.col(column),
                            "label_confidence": F.lit(0.75)})


def face_priority_seed(df: DataFrame, key: str, condition: str, k: int) -> DataFrame:
    """Seeds by face priority; the no-face form prefers little screen and text and more sharpness."""
    c = F.col
    if condition == "no_face":
        df = df.filter(c("no_face_flag") & (c("screen_score") < 0.12) & (c("text_score") <= 5))
        score = c("screen_score") * -10.0 + c("text_score") * -1.0 + c("blur_score") / 200.0
    else:
        score = c("face_count") * 5.0 + c("largest_face_size_px")
    return df.withColumn("face_priority_score", score).orderBy(c("face_priority_score").desc(), c(key)).limit(max(10 * k, 250))


def overlay(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Union in which the primary row of a key wins."""
    tagged = primary.withColumn("__p", F.lit(0)).unionByName(fallback.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return keep_one(tagged, [key], [F.col("__p")]).drop("__p")


def exclude_overlap(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key no other table uses."""
    for other in others:
        df = df.join(other.select(key), key, "left_anti")
    return df


def chained_subsets(df: DataFrame, key: str, definitions: Sequence[dict], seed: int = 42) -> DataFrame:
    """Subsets drawn one after another from the rows that are left, tagged with their name."""
    left, out = df, None
    for spec in definitions:
        part = stratified_sample(left, key, spec["strata"], spec["n"], seed).withColumn("subset", F.lit(spec["name"]))
        left = exclude_overlap(left, key, part)
        out = part if out is None else out.unionByName(part)
    return out


def large_sample(df: DataFrame, key: str, strata: Sequence[str], n: int, locked: Sequence[DataFrame], seed: int = 42) -> DataFrame:
    """Stratified sample outside the locked sets."""
    return stratified_sample(exclude_overlap(df, key, *locked), key, strata, n, seed)


def balanced_protocol_sample(df: DataFrame, key: str, protocol: str, n: int, seed: int = 42) -> DataFrame:
    """Equal share per protocol, topped up in hash order."""
    protocols = df.select(protocol).distinct().count()
    share = n // max(protocols, 1)
    base = top_k(df, [protocol], _by_hash(seed, key), share, "__rank").drop("__rank")
    rest = exclude_overlap(df, key, base)
    return base.unionByName(rest.orderBy(*_by_hash(seed, key)).limit(max(n - base.count(), 0)))


def fold_segments(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Folds that biggest-first into the lightest fold gives to ``sizes``, pairs (group size, number of groups) by falling size.

    A segment (size, rank, folds) says that the groups of a size from this rank on take these folds in turn. Within a size the
    folds that lie less than one group above the lightest take one group each, in the order of their loads, until the next
    heavier fold comes into reach; so a size has at most k segments however many groups it has.
    """
    loads, out = [0] * k, []
    for size, groups in sizes:
        rank = 0
        while rank < groups:
            order = sorted(range(k), key=lambda i: (loads[i], i))
            low = loads[order[0]]
            active = [i for i in order if loads[i] < low + size]
            heavier = [loads[i] for i in order if loads[i] >= low + size]
            left = groups - rank
            rounds = min((heavier[0] - low) // size, -(-left // len(active))) if heavier else -(-left // len(active))
            taken = min(left, rounds * len(active))
            for place, fold in enumerate(active):
                loads[fold] += size * (taken // len(active) + (place < taken % len(active)))
            out.append((size, rank, [i + 1 for i in active]))
            rank += taken
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5, limit: int = GROUP_LIMIT) -> DataFrame:
    """Fold per group, 1-based, biggest group first into the lightest fold. No group is in two folds; null is a group.

    Only the histogram of group sizes comes to the driver, whose length grows with the square root of the rows at most. A
    group's rank among those of its size finds its fold.
    """
    sizes = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("__size")))
    histogram = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("__size").desc()).collect()
    segments = fold_segments([(row["__size"], row["n"]) for row in histogram], k)
    table = df.sparkSession.createDataFrame(segments, "__size bigint, __from bigint, __folds array<int>")
    table = table.groupBy("__size").agg(F.array_sort(F.collect_list(F.struct("__from", "__folds"))).alias("__segments"))
    ranked = running_totals(sizes, ["__size"], [F.col(group)], {"__rank": F.lit(1)}, limit).join(broadcast_if_small(table), "__size")
    found = F.element_at(F.filter("__segments", lambda s: s["__from"] < F.col("__rank")), -1)
    turn = F.pmod(F.col("__rank") - 1 - found["__from"], F.size(found["__folds"])).cast("int")
    folds = ranked.select(group, F.get(found["__folds"], turn).cast("bigint").alias("fold"))
    return null_safe_join(df, folds, [group])


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, limit: int = GROUP_LIMIT) -> DataFrame:
    """Folds balanced per class; plain folds when a class has fewer than k rows."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    group = [label] if smallest >= k else []
    placed = running_totals(df, group, _by_hash(seed, key), {"__place": F.lit(1)}, limit)
    return placed.withColumn("fold", F.pmod(F.col("__place"), F.lit(k)) + 1).drop("__place")


def split_half(df: DataFrame, key: str, seed: int = 42, limit: int = GROUP_LIMIT) -> DataFrame:
    """First half in hash order is the reference, the rest the comparison; the last odd row is left out."""
    n = df.count()
    if n < 4:
        raise ValueError("both halves need at least two rows")
    placed = running_totals(df, [], _by_hash(seed, key), {"__place": F.lit(1)}, limit)
    side = F.when(F.col("__place") <= n // 2, "reference").otherwise("comparison")
    return placed.filter(F.col("__place") <= 2 * (n // 2)).withColumn("half", side).drop("__place")


def pair_sample(pairs: DataFrame, n: int, strata: Sequence[str] = ("day_id", "exocentric_stream_id"), seed: int = 42) -> DataFrame:
    """P20: stratified sample of pairs with a stable pair id."""
    pair_id = F.sha2(F.concat_ws("|", "egocentric_relative_path", "exocentric_relative_path"), 256)
    return stratified_sample(pairs.withColumn("pair_id", pair_id), "pair_id", strata, n, seed)


def lock_variant(table: DataFrame, score: str, locked: str | None = None, split: str = "development") -> DataFrame:
    """Selected variant per modality.  Selection on the test split is refused; a locked id always wins."""
    if split != "development":
        raise ValueError("variants may be selected on the development split only")
    rows = table.filter(F.col("split") == split)
    first = F.col("variant") == locked if locked else F.lit(False)
    return keep_one(rows, ["modality"], [first.desc(), F.col(score).desc(), F.col("variant")])
