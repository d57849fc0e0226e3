"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing column names in every operator and stage."""

import textwrap

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frameops.llm import decontaminate, jaccard, langid, licences, neighbours, packing, passages, pii, toxicity, warc
from frameops.llm.tables import Scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, n_words long, n_spans long, score string, sig_a long, piece string"
LONG = "word " * 20_000
HUGE = "x" * 300_000
COMMON = " ".join(f"w{i}" for i in range(80))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, COMMON), (4, COMMON), (5, COMMON), (6, "a different text of id six"), (6, "one more of id six"), (None, COMMON), (None, None),
    (7, LONG), (8, HUGE), (9, "Ünï ñ 中文 \U0001f600"), (10, "mail bob@example.com or +1 (838) 555-9577 now"), (11, "!!! ???"), (2, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), 0.5, 7, 3, "mine", 5, "p") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, q, t) for i, q, t in [(1, 1, 1), (4, 0, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (6, 1, 0)]], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(0, " ".join(f"w{i}" for i in range(20, 40))), (0, " ".join(f"w{i}" for i in range(20, 40))), (1, None), (2, ""), (3, "id six"), (None, "one more of id")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_jaccard(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(odd).collect()]
    assert len(got) == len(ROWS)
    assert got.count((4, 76, 4)) == 2 and (5, 76, 4) in got and (None, 76, None) in got
    assert got.count((2, 0, 2)) == 2 and (1, 0, 1) in got and (7, 1, 7) in got and (8, 1, 8) in got and (6, 2, 6) in got and (6, 1, 6) in got
    assert jaccard.jaccard_join(none).count() == 0


def test_one_of_each(odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert len(got) == len(ROWS) - 2  # the repeat of 4, and 5


def test_ids_with_several_texts_are_told_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (0, texts[2])]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


def test_decontaminate(odd, none, benchmark):
    found = decontaminate.decontaminate(odd, benchmark)
    assert found.count() == len(ROWS) and dict(found.dtypes)["score"] == "string"
    rows = {(r.doc_id, r.text): r for r in found.collect()}
    assert rows[4, COMMON].n_hit == 20 and rows[4, COMMON]["items"] == ["0"] and [tuple(s) for s in rows[4, COMMON].hit_spans] == [(20, 40)]
    assert rows[6, "a different text of id six"]["items"] == ["3"] and rows[6, "one more of id six"]["items"] == ["", "3"]
    assert rows[1, None].n_words == 0 and not rows[1, None].contaminated and rows[7, LONG].n_words == 20_000
    assert decontaminate.decontaminate(none, benchmark).count() == 0
    clean = decontaminate.decontaminate(odd, benchmark.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(ROWS)


def test_toxicity(odd, none, labels):
    scored = toxicity.score(odd, toxicity.train(odd, labels))
    assert scored.count() == len(ROWS) and scored.where("toxicity BETWEEN 0 AND 1").count() == len(ROWS)
    nothing = toxicity.train(none, labels.limit(0))
    assert toxicity.score(none, nothing).count() == 0
    assert toxicity.score(odd, nothing).select("toxicity").distinct().count() == 1


def test_pii(odd, none):
    field = pii.train(odd)
    masked = pii.mask(odd, field)
    got = {(r.doc_id, r.n_spans): r.text for r in masked.collect()}
    assert got[10, 2] == "mail [EMAIL] or [PHONE] now" and got[1, 0] is None and got[2, 0] == ""
    assert masked.count() == len(ROWS)
    assert pii.mask(none, pii.train(none)).count() == 0


def test_packing(odd, none):
    packed = packing.pack(odd, VOCABULARY).toPandas()
    lengths = packed.groupby("sequence_id").length.sum()
    assert lengths.max() <= packing.CAPACITY
    empty = packed[packed.doc_id.isin([1, 2, 3])]
    assert len(empty) == 4 and (empty.length == 1).all()
    assert packing.pack(none, VOCABULARY).count() == 0


def test_language(odd, none):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(odd, langid.train(odd)).select("doc_id", "text", "lang_pred", F.col("score")).collect()}
    assert got[1, None] == ("und", 0.0) and got[11, "!!! ???"] == ("und", 0.0) and got[9, ROWS[12][1]][0] == "en"
    unknown = langid.identify(odd, langid.train(none))
    assert unknown.where("lang_pred <> 'und'").count() == 0 and langid.identify(none, langid.train(none)).count() == 0


def test_licences(odd, none):
    model = licences.train(none)
    assert licences.licence_paragraphs(odd, model).count() == 0 and licences.licence_paragraphs(none, model).count() == 0
    notice = odd.limit(1).select(F.lit(3).alias("doc_id"), F.lit("some words\nReleased under the MIT License.").alias("text"))
    found = licences.licence_paragraphs(notice, model).collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in found] == [(3, 1, "mit", True)]


def test_variants_of_notices_in_the_sample_change_nothing(spark):
    plain = [f"a{i} b{i % 7} went to see c{i % 11} about d{i % 13}" for i in range(300)]
    variants = [f"Permission is hereby granted, free of charge, to any person obtaining a copy of part {i}" for i in range(40)]
    lines = plain + variants + [licences.NOTICES["mit"][2]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model = licences.train(docs)
    assert model.threshold == 0.5 and {"permission", "granted", "copy"} <= set(model.cues)
    found = licences.licence_paragraphs(docs, model).where("confirmed").collect()
    assert (len(lines) - 1, "mit") in [(r.doc_id, r.family) for r in found]


def test_wrapped_notices(spark):
    notices = [(family, text) for family, n in (("mit", 2), ("bsd", 0), ("gpl", 1)) for text in [licences.NOTICES[family][n]]]
    wrapped = [(f, "\n".join(textwrap.wrap(t, width, initial_indent=mark, subsequent_indent=mark))) for f, t in notices for width, mark in ((72, ""), (48, "# "), (30, " * "))]
    texts = [f"some words before\n\n{w}\n\nand more behind" for _, w in wrapped] + [f"{w}\n\n{w}" for _, w in wrapped]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licences.licence_paragraphs(docs, licences.train(docs.limit(0))).where("confirmed").collect()
    assert sorted((r.doc_id, r.family) for r in found) == sorted((i + k, f) for i, (f, _) in enumerate(wrapped) for k in (0, len(wrapped), len(wrapped)))


def test_passages(odd, none):
    got = {(r.doc_id, r.start, r.end, r.kept) for r in passages.repeated_passages(odd).collect()}
    assert got == {(4, 0, 80, True), (5, 0, 80, False)}
    assert passages.repeated_passages(none).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.01], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1),
            (9, [inf, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1e38, 1e36], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(9))
    got = sorted(map(tuple, neighbours.near_duplicates(frame).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True), (12, 1, 3, False), (None, 0, None, True)] + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=str)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", "x"), (3, None, "x"), (3, "u", "x"), (2, "u\r\nX: y", None), (5, "u", ""), (None, "u", "x"), (None, "u", "alone"), (9, "u", "é" * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=str)
    want = [(1, 1, "revisit", 3), (3, 1, "response", None), (3, 1, "response", None), (2, 0, "revisit", 5), (5, 0, "response", None), (None, 1, "revisit", 3), (None, 5, "response", None), (9, 200_000, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).count() == 0


def _tables(folder, docs, labels, benchmark):
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_pipeline_stages(spark, odd, labels, benchmark, tmp_path):
    folder = _tables(tmp_path, odd, labels, benchmark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, folder), name)
        assert after.columns == docs.columns, name
        assert after.where("score <> 'mine' OR n_words <> 7").count() == 0
        docs = after
    left = {(r.doc_id, r.text) for r in docs.collect()}
    assert (10, "mail [EMAIL] or [PHONE] now") in left and (8, HUGE) in left
    assert not {i for i, _ in left} & {4, 5, 6}  # item words


def test_pipeline_of_empty_tables(spark, none, labels, benchmark, tmp_path):
    assert corpus_pipeline.run(spark, _tables(tmp_path, none, labels.limit(0), benchmark.limit(0))).count() == 0


def test_licence_order_and_null_ids(spark):
    """Words of a notice out of order are no notice; notices without an id are reported; ties go to the first family by name."""
    isc = licences.NOTICES["isc"][0]
    rows = [(1, "The hotel told us that all rights were reserved for members."), (2, "reserved seats, rights of way and all the rest"), (3, isc), (4, isc.replace("copy, ", "")), (None, "Released under the MIT License."), (None, "nothing here"), (5, None), (6, "")]
    rows += [(6, "Licensed under the MIT License.\n\nDistributed under the Boost Software License, Version 1.0.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    got = sorted((str(r.doc_id), r.n_paragraphs, r.families) for r in licences.licence_report(docs).collect())
    assert got == sorted([("1", 0, ""), ("2", 0, ""), ("3", 1, "isc"), ("4", 1, "isc"), ("None", 1, "mit"), ("None", 1, "mit"), ("5", 0, ""), ("6", 2, "bsl-1.0,mit"), ("6", 2, "bsl-1.0,mit")])
    assert licences.licence_report(docs.limit(0)).count() == 0


def test_licence_model_reads_all_lines(spark, monkeypatch):
    """Cues come from every line, not from a sample whose size decides them."""
    lines = [f"a{i} b{i % 7} went to see c{i % 11} about d{i % 13}" + " boost" * (i % 50 == 0) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    monkeypatch.setattr(licences, "BACKGROUND", 8)
    assert "boost" not in licences.train(docs).cues
