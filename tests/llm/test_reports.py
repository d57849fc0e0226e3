"""The registered reports of operators without a SQL twin, row by row against plain code on the given tables."""

import hashlib
import zlib

import pytest

from frameops.llm import pii, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_pii_report(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op5_pii"](spark, SF).collect()}
    assert got.keys() == documents.keys()
    added = 0
    for i, row in got.items():
        base = pii.base_spans(documents[i].text or "")
        named = [f"{kind}:{start}:{end}" for start, end, kind in base]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for _, _, k in base) for kind in ("email", "ip", "card", "phone")]
        assert row.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        every = row.spans.split(",") if row.spans else []
        assert set(named) <= set(every) and every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
        added += len(every) - len(named)
    assert sum(r.n_email for r in got.values()) > 0 and added >= 0


def test_toxicity_report(spark, documents):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, SF).collect()}
    assert got.keys() == documents.keys()
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    # labels hold about 4 % noise
    checked = [got[i].predicted == t for i, t in labels.items() if i in got and t is not None and held_out(i)]
    assert sum(checked) >= 0.9 * len(checked) > 0


def test_language_report(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, SF).collect()}
    assert got.keys() == documents.keys()
    learned = {d.lang for i, d in documents.items() if d.lang is not None and not held_out(i)}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.lang_pred in learned | {"und"} for i, r in got.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in documents[i].text or "")) for i, r in got.items())
    checked = [got[i].lang_pred == d.lang for i, d in documents.items() if d.lang is not None and held_out(i) and got[i].lang_pred != "und"]
    assert sum(checked) >= 0.97 * len(checked) > 0
