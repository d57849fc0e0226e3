"""Licence scan of paragraphs, in DataFrame operations only.

A multinomial logistic regression over sparse word n-grams (one to three words) tells licence families from ordinary text. It is
trained on notices of each family, also with words left out or in strange surroundings, and on all lines of the corpus, each
different one once, as the class ``unknown``, without those that hold some of a notice's wording; one in four is set apart. Lines
with the same features are one weighted row, and the class weighs as much as ``BACKGROUND`` lines, however many there are. Features
are n-grams of the notices that hold a cue, a word that is rare in the lines or much more frequent in the notices; so a paragraph
without a cue has no feature and is unknown, and only documents with a cue are split into paragraphs. A paragraph is a line, or a
run of adjacent lines without a blank one between that a notice can span when it is wrapped. A family counts if its probability
exceeds both one half and what all but a few (``OVER``, and one more) of the lines set apart reach, and if
the paragraph follows a notice of that family closely enough: of its pairs of adjacent words, those that stand in this order in
the notice, with at most one of the notice's words left out between them, make up ``TEMPLATE_SHARE`` of the notice's pairs.

Defined results: a null or empty text has no paragraph; the shortest runs of lines count, and those of one family that overlap
are one paragraph; repeated rows of an id share the findings of all its rows, and so do rows without an id; of families
with equal probability the first by name counts.
"""

from __future__ import annotations

import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameops.llm.tables import Scratch

#: Most weight of the class unknown in training; rarity of cues in its lines; least share of a notice's pairs of words that a
#: paragraph holds in order.
BACKGROUND, CUE_SHARE, TEMPLATE_SHARE = 3000, 0.002, 0.6
#: How often more in notices than in the corpus makes a cue; share of a notice's three-word runs that keeps a line out of the
#: class unknown; share of the lines set apart that may be over the threshold.
CONTRAST, ALIKE, OVER = 10, 0.15, 0.01
UNKNOWN = "unknown"

# Wording of public licence notices, by SPDX-like family.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain under CC0 1.0."),
    "all-rights-reserved": ("All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without written permission."),
}

_WORD_BREAK, _MARK = "[^a-z0-9]+", "\x01"


def _words(column):
    return F.filter(F.split(F.lower(column), _WORD_BREAK), lambda w: w != "")


def _runs(words, n: int):
    """Runs of n words."""
    # the lambda has one parameter: a second one, with a default too, is the index
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _ngrams(words):
    return F.concat(*[_runs(words, n) for n in (1, 2, 3)])


def _plain(text: str) -> list[str]:
    return [w for w in re.split(_WORD_BREAK, text.lower()) if w]


def _pairs(text: str) -> list[str]:
    """Pairs of words of a notice that follow each other, also with one word between left out."""
    plain = _plain(text)
    return sorted({f"{a} {b}" for step in (1, 2) for a, b in zip(plain, plain[step:])})


def _alike(words):
    """Whether a paragraph holds some of the wording of a notice."""
    runs, tests, every = _runs(words, 3), [], set()
    for text in (t for texts in NOTICES.values() for t in texts):
        plain = _plain(text)
        own = sorted({" ".join(plain[i : i + 3]) for i in range(len(plain) - 2)})
        every.update(own)
        tests.append(F.size(F.array_intersect(F.array(*map(F.lit, own)), runs)) >= ALIKE * len(own))
    # few paragraphs hold a run of any notice
    return F.when(F.exists(runs, lambda r: r.isin(*sorted(every))), F.array_contains(F.array(*tests), True)).otherwise(False)


def _rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small literal table."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(values)), f"array<struct<{schema}>>")))


def _variants(text: str) -> list[str]:
    """A notice, and the notice without each one of its words."""
    words = text.split()
    return [text] * 3 + [" ".join(words[:i] + words[i + 1 :]) for i in range(len(words)) if len(words) > 2]


def _reach(n: int) -> int:
    """Words that a notice of n words spans at most, with half as many that are not its own."""
    return n * 3 // 2


LONGEST = max(_reach(len(_plain(t))) for texts in NOTICES.values() for t in texts)


def _grams(text: str) -> set[str]:
    plain = _plain(text)
    return {" ".join(plain[i : i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


class Model:
    def __init__(self, cues: list[str], weights: list[tuple], intercepts: dict[str, float], threshold: float) -> None:
        self.cues, self.weights, self.intercepts, self.threshold = cues, weights, intercepts, threshold
        held = set(cues)
        variants = {v for texts in NOTICES.values() for t in texts for v in _variants(t)}
        self.vocabulary = sorted(g for g in set().union(*map(_grams, variants)) if not held.isdisjoint(g.split(" ")))

    def features(self, words):
        """Different n-grams of notices that hold a cue."""
        return F.array_sort(F.array_distinct(F.filter(_ngrams(words), lambda g: g.isin(*self.vocabulary))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, paragraph, words) of the lines of texts."""
    rows = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull())
    # words made inside the generator are made once, whatever filters follow
    rows = rows.select("doc_id", F.posexplode(F.transform(F.split("text", "\n+"), _words)).alias("paragraph", "words"))
    return rows.where(F.size("words") > 0)


def _tail(words, n):
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n)


def candidates(docs: DataFrame, cues: list[str]) -> DataFrame:
    """Lines, and runs of adjacent lines that one notice can span, that hold a cue.

    Columns: row (a number of each row of ``docs``), doc_id, paragraph and until (first and last line), words, and n_first and
    n_last, the words of a run's first and last line; both are 0 for a line. The lines between are whole in a notice, so they
    hold less than ``LONGEST`` words; of the first line the last words count, of the last line the first ones.
    """
    has = lambda words: F.arrays_overlap(words, F.array(*map(F.lit, cues)).cast("array<string>"))
    rows = docs.where(F.col("text").isNotNull()).where(has(F.split(F.lower("text"), _WORD_BREAK))).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # the first line behind blank ones is marked
    lines = rows.select("row", "doc_id", F.posexplode(F.split(F.regexp_replace("text", "\n\n+", f"\n{_MARK}"), "\n")).alias("paragraph", "line"))
    lines = lines.select("row", "doc_id", "paragraph", F.col("line").startswith(_MARK).alias("opens"), _words(F.col("line")).alias("words"))
    order = Window.partitionBy("row").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum((F.col("opens") | (F.size("words") == 0)).cast("int")).over(order)).withColumn("end", F.sum(F.size("words")).over(order))
    lines = lines.where(F.size("words") > 0).withColumn("cued", F.max(has(F.col("words"))).over(Window.partitionBy("row", "block"))).where("cued")
    line = F.struct("paragraph", (F.col("end") - F.size("words")).alias("start"), F.slice("words", 1, LONGEST).alias("words"))
    near = Window.partitionBy("row", "block").orderBy("paragraph").rowsBetween(1, LONGEST)
    lines = lines.withColumn("ahead", F.collect_list(line).over(near)).withColumn("ahead", F.filter("ahead", lambda x: x["start"] - F.col("end") < LONGEST))
    runs = lines.select("row", "doc_id", "paragraph", "words", "ahead", F.explode(F.sequence(F.lit(0), F.size("ahead"))).alias("more"))
    first, last, alone = _tail(F.col("words"), LONGEST), F.try_element_at("ahead", F.nullif("more", F.lit(0))), F.col("more") == 0
    joined = F.concat(first, F.flatten(F.transform(F.slice("ahead", 1, F.col("more")), lambda x: x["words"])))
    runs = runs.select("row", "doc_id", "paragraph", F.when(alone, F.col("paragraph")).otherwise(last["paragraph"]).alias("until"), F.when(alone, F.col("words")).otherwise(joined).alias("words"), F.when(alone, 0).otherwise(F.size(first)).alias("n_first"), F.when(alone, 0).otherwise(F.size(last["words"])).alias("n_last"))
    return runs.where(has(F.col("words")))


def _background(docs: DataFrame) -> DataFrame:
    """Rows (key, apart, words) of all lines that are unlike notices; equal lines have equal keys."""
    rows = paragraphs(docs).where(~_alike(F.col("words")))
    return rows.select(F.xxhash64("words").alias("key"), (F.pmod(F.xxhash64("words", F.lit(31)), F.lit(4)) == 0).alias("apart"), "words")


def train(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark, "licences")
    texts = [set(_plain(t)) for texts in NOTICES.values() for t in texts]
    shares = {w: sum(w in t for t in texts) / len(texts) for w in set().union(*texts) if len(w) > 1}
    # different lines, and those with each word of the notices; the word "" stands for all of them
    background = _background(docs)
    held = background.select("key", "apart", F.array_distinct(F.filter("words", lambda w: w.isin(*shares))).alias("held"))
    held = held.groupBy("key", "apart").agg(F.first("held").alias("held")).select("apart", F.explode(F.concat("held", F.array(F.lit("")))).alias("word"))
    counts = {(r.word, r.apart): r.n for r in held.groupBy("word", "apart").agg(F.count("*").alias("n")).collect()}
    often = {w: counts.get((w, False), 0) + counts.get((w, True), 0) for w in ("", *shares)}
    lines, apart = often[""], counts.get(("", True), 0)
    cues = sorted(w for w, share in shares.items() if often[w] <= CUE_SHARE * lines + 1 or CONTRAST * often[w] <= share * lines)

    families = [UNKNOWN, *sorted(NOTICES)]
    model = Model(cues, [], {}, 0.5)
    cued = background.where(F.exists("words", lambda w: w.isin(*cues))).select("key", "apart", model.features(F.col("words")).alias("grams"))
    sets = cued.where(F.size("grams") > 0).dropDuplicates(["key"]).groupBy("grams", "apart").agg(F.count("*").alias("n"))
    sets = scratch.keep(sets, "sets")
    plain = lines - apart
    scale = min(1.0, BACKGROUND / max(1, plain))
    unknown = sets.where("NOT apart")
    bare = plain - (unknown.agg(F.sum("n")).first()[0] or 0)
    vocabulary = set(model.vocabulary)
    rows = [(float(families.index(k)), 1.0, sorted(_grams(v) & vocabulary)) for k, texts in NOTICES.items() for t in texts for v in _variants(t)]
    # lines without a feature
    rows += [(0.0, bare * scale, [])] * (bare > 0)
    rows = spark.createDataFrame(rows, "label double, weight double, grams array<string>").union(unknown.select(F.lit(0.0), F.col("n") * scale, "grams"))
    counted = CountVectorizerModel.from_vocabulary(model.vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.1, maxIter=60, weightCol="weight").fit(counted.transform(rows))
    matrix = fitted.coefficientMatrix.toArray()
    model.weights = [(g, [round(float(x), 6) for x in matrix[:, j]]) for j, g in enumerate(model.vocabulary) if abs(matrix[:, j]).max() > 1e-6]
    model.intercepts = dict(zip(families, map(float, fitted.interceptVector)))
    held = sets.where("apart").select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("paragraph"), F.lit(0).alias("until"), "n", "grams")
    model.threshold = _threshold(scratch.keep(_probabilities(held, model).select("probability", "n"), "held"), 1 + int(OVER * apart))
    return model


def _threshold(held: DataFrame, over: int) -> float:
    """The probability that ``over`` lines of ``held`` (probability, n) exceed at most, to a millionth, or one half if that is more."""
    low, step, above = 0.5, 5e-4, 0
    for _ in range(2):
        place = F.ceil((F.col("probability") - low) / step)
        bins = held.where(place.between(1, 1000)).groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.max("probability").alias("most")).collect()
        for r in sorted(bins, key=lambda r: -r.place):
            if above + r.n > over:
                low, step, found = low + (r.place - 1) * step, step / 1000, r.most
                break
            above += r.n
        else:
            return low
    return found


def _probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (row, paragraph, until, grams ...) that have a feature, with their best family and its probability."""
    spark, names, key = rows.sparkSession, list(model.intercepts), ["row", "paragraph", "until"]
    rest = [c for c in rows.columns if c not in [*key, "grams"]]
    # the table has an entry for each n-gram of the notices
    table = spark.createDataFrame(model.weights, "gram string, weights array<double>")
    grams = rows.select(*key, *rest, F.explode("grams").alias("gram"))
    scored = grams.join(F.broadcast(table), "gram")
    sums = scored.groupBy(*key).agg(*[F.any_value(c).alias(c) for c in rest], *[F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(len(names))])
    odds = F.array(*[F.exp(F.col(f"w{i}") + F.lit(model.intercepts[k])) for i, k in enumerate(names)])
    known = F.array(*map(F.lit, names))
    sums = sums.select(*key, *rest, odds.alias("odds")).withColumn("total", F.aggregate("odds", F.lit(0.0), lambda x, y: x + y))
    each = F.transform("odds", lambda o, i: F.struct((o / F.col("total")).alias("probability"), (-i).alias("order"), F.get(known, i).alias("family")))
    best = F.array_max(F.filter(each, lambda x: x["family"] != UNKNOWN))
    return sums.select(*key, *rest, best.alias("best")).select(*key, *rest, "best.family", "best.probability")


def licence_paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """Paragraphs with a licence: doc_id, paragraph (its first line), family, probability, template_share, confirmed."""
    rows = candidates(docs, model.cues).withColumn("grams", model.features(F.col("words")))
    found = _probabilities(rows, model).where(F.col("probability") > model.threshold)
    templates = [{"family": k, "pairs": _pairs(t), "steps": len(_plain(t)) - 1, "reach": _reach(len(_plain(t)))} for k, texts in NOTICES.items() for t in texts]
    templates = _rows(docs.sparkSession, templates, "family: string, pairs: array<string>, steps: int, reach: int").groupBy("family").agg(F.collect_list(F.struct("pairs", "steps", "reach")).alias("templates"))
    n, n_first, n_last = F.size("words"), F.col("n_first"), F.col("n_last")

    def share(t):
        # of a run of lines, the words that a notice of this length can hold
        skip, drop = F.greatest(F.lit(0), n_first - t["reach"]), F.greatest(F.lit(0), n_last - t["reach"])
        held = F.when(n_last == 0, F.col("words")).when(n - n_first - n_last < t["reach"], F.slice("words", skip + 1, n - skip - drop)).otherwise(F.array().cast("array<string>"))
        return F.least(F.lit(1.0), F.size(F.array_intersect(t["pairs"], _runs(held, 2))) / t["steps"])

    found = found.join(F.broadcast(templates), "family").withColumn("template_share", F.array_max(F.transform("templates", share)))
    found = found.withColumn("confirmed", F.col("template_share") >= TEMPLATE_SHARE).where("confirmed OR n_last = 0")
    # runs that hold a shorter one of their family go; runs that overlap are one paragraph
    groups = ["row", "family", "confirmed"]
    inner = Window.partitionBy(*groups).orderBy(F.desc("paragraph"), "until").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("inner", F.min("until").over(inner)).where("inner IS NULL OR inner > until")
    order = Window.partitionBy(*groups).orderBy("paragraph")
    found = found.withColumn("opens", F.coalesce(F.col("paragraph") > F.lag("until").over(order), F.lit(True)).cast("int")).withColumn("number", F.sum("opens").over(order))
    surest = F.max_by(F.struct("doc_id", "paragraph", "probability", "template_share"), F.struct("probability", -F.col("paragraph"))).alias("surest")
    return found.groupBy(*groups, "number").agg(surest).select("surest.doc_id", "surest.paragraph", "family", "surest.probability", "surest.template_share", "confirmed")


def licence_report(docs: DataFrame) -> DataFrame:
    """A row per document: confirmed licence paragraphs, their families, the surest family and its probability."""
    found = licence_paragraphs(docs, train(docs)).where("confirmed")
    best = F.max_by("family", F.struct("probability", F.struct(-F.col("paragraph"))))
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), best.alias("family"), F.max("probability").alias("score"))
    found = found.withColumnRenamed("doc_id", "found_in")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("found_in")), "left")
    return out.select("doc_id", F.coalesce("n_paragraphs", F.lit(0).cast("long")).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("family", F.lit(UNKNOWN)).alias("family"), F.coalesce("score", F.lit(0.0)).alias("score"))
