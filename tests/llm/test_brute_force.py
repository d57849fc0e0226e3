"""Operators against plain code on small inputs."""

import io
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameops.llm import decontaminate, jaccard, langid, neighbours, packing, passages, pii, tables, tokens, toxicity, warc, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def copies(rng, n, length, vocabulary):
    """Texts in groups of near copies, with words changed at random, and a passage that many share."""
    passage = [f"p{i}" for i in range(60)]
    texts = []
    while len(texts) < n:
        base = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, length))]
        if rng.random() < 0.3:
            at = rng.randrange(len(base))
            base[at:at] = passage
        for _ in range(rng.choice([1, 1, 2, 12])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(vocabulary)}"
            texts.append(" ".join(own))
    return texts[:n]


@pytest.mark.parametrize("kind,pattern", [("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(kind, pattern):
    texts = ["", None, "Hello  World hello\tWORLD", "été Été a", " x", "x ", "a1_b-c\x0bd", "\x00z"]
    for low, high, w in words.each_chunk(pa.array(texts), kind):
        for i, text in enumerate(texts[low:high]):
            own = slice(w.first[i], w.first[i + 1])
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
            lowered = [re.sub("[A-Z]", lambda m: m.group().lower(), bytes(w.data[a:b]).decode()) for a, b in zip(w.start[own], w.end[own])]
            assert lowered == re.findall(pattern, lower)
            assert len(set(w.hash[own].tolist())) == len(set(lowered))


@pytest.mark.parametrize("limit", [0, 500_000])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(tables, "TASK_LINKS", limit)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100)] + [(500, rng.randrange(600, 900)) for _ in range(50)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(100)] + [(5, 5)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = tables.components(tables.Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == groups(nodes, [(a, b) for a, b in links if a != b])


def test_jaccard_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    texts = copies(random.Random(4), 250, 120, 400)
    sets = {}
    for i, text in enumerate(texts):
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(sets, links)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


@pytest.mark.parametrize("block_bytes,broadcast_bytes", [(60, 10**6), (8_000_000, 10**6), (8_000_000, 0)])
def test_decontamination_of_short_and_long_items(spark, block_bytes, broadcast_bytes):
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(12)]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, run(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)]
    docs = [(i, f"{run(rng.randrange(12))} {rng.choice(items)[1]}, {run(rng.randrange(12))}") for i in range(60)]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, broadcast_bytes=broadcast_bytes)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found.collect()}
    for i, text in docs:
        w, hit, names = re.findall(r"\w+", text), set(), set()
        for item, content in items:
            x = content.split()
            size = min(10, len(x))
            for k in range(len(x) - size + 1 if size else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == x[k : k + size]:
                        hit |= set(range(at, at + size))
                        names.add(str(item))
        assert got[i] == (len(w), len(hit), sorted(names))


def test_decontamination_ways_agree(spark):
    """Broadcast blocks and the join give equal rows on the given tables, with nulls, repeated rows and clashing columns."""
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "benchmark"))
    odd = spark.createDataFrame([(None, None), (None, ""), (5, "?"), (7, "one two three"), (7, "one two three"), (8, "x " * 3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).withColumns({"items": F.lit(1), "row_of_docs": F.lit(2), "k": F.lit(3)}).repartition(3)
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").union(spark.createDataFrame([(None, "two three"), ("q", None), ("r", ""), ("s", "x " * 30)], "item_id string, text string"))
    ways = [decontaminate.decontaminate(docs, benchmark, broadcast_bytes=limit) for limit in (10**9, 0)]
    rows = [sorted(map(str, (r.asDict() for r in way.select("doc_id", "text", "n_words", "n_hit", "hit_spans", "items", "contaminated").collect()))) for way in ways]
    assert rows[0] == rows[1] and sum("'contaminated': True" in r for r in rows[0]) > 5
    assert decontaminate.decontaminate(docs.limit(0), benchmark, broadcast_bytes=0).count() == 0


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([rng.standard_normal((600, 32)), np.repeat(centres, 10, 0) + rng.standard_normal((600, 32)) * 0.15, np.repeat(centres[:1], 300, 0) + rng.standard_normal((300, 32)) * 0.1])
    label = rng.integers(0, 3, len(x))
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = neighbours.near_duplicates(frame).toPandas().set_index("vec_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    assert (got.n_links.to_numpy() <= linked.sum(1)).all()
    assert got.n_links.sum() >= 0.97 * linked.sum()
    exact = groups(range(len(x)), np.argwhere(np.triu(linked)).tolist())
    assert np.mean([got.component_id[i] == exact[i] for i in exact]) > 0.98


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 40, 300).astype(np.uint64)
    doc, first, last = np.repeat([0, 1, 2], [120, 60, 120]), np.array([0, 120, 180]), np.array([116, 176, 296])
    for function in range(passages.FUNCTIONS):
        centre, low, high, value = passages.compact_windows(grams, doc, first, last, function)
        order = {int(c): int(v) >> 20 for c, v in zip(range(300), words.mix(grams ^ np.uint64(0x9E3779B97F4A7C15 * (2 * function + 3) & (2**64 - 1))))}
        want = []
        for d in range(3):
            for i in range(first[d], last[d]):
                key = lambda j: (order[j], j)
                a, b = i, i + 1
                while a > first[d] and key(a - 1) > key(i):
                    a -= 1
                while b < last[d] and key(b) > key(i):
                    b += 1
                if b - a >= passages.MIN_WORDS - passages.SHINGLE + 1:
                    want.append((i, a, b))
        assert want == list(zip(centre.tolist(), low.tolist(), high.tolist()))


@pytest.mark.parametrize("hot,parts", [(100_000, 4), (64, 4), (64, 1)])
def test_repeated_passages(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(passages, "HOT_WINDOWS", hot)
    monkeypatch.setattr(passages, "HOT_SAMPLE", 1)
    rng = random.Random(8)
    shared = [[f"s{k}x{i}" for i in range(n)] for k, n in enumerate([50, 55, 70, 300])]
    texts, planted = [], {}
    for i in range(240):
        own = [f"u{i}x{j}" for j in range(rng.randrange(150))]
        if i % 2:
            k = rng.randrange(4) if i % 3 else 3
            own[len(own) // 2 : len(own) // 2] = shared[k]
            planted[i] = k
        texts.append((i, " ".join(own)))
    got = passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)).toPandas()
    assert set(got.doc_id) == set(planted)
    lengths = (got.end - got.start).to_numpy()
    assert (lengths == [len(shared[planted[i]]) for i in got.doc_id]).all()
    assert got.groupby(got.doc_id.map(planted)).class_id.nunique().max() == 1 and got.kept.sum() == 4


def test_near_passages(spark):
    """Recall against the library's own verification on all pairs; the same rows for any number of partitions."""
    rng = random.Random(5)
    shared = [[f"s{k}x{i}" for i in range(80)] for k in range(3)]
    texts = []
    for i in range(200):
        own = [f"u{i}x{j}" for j in range(rng.randrange(150))]
        if i % 10 < 8:
            passage = list(shared[i % 3])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randrange(2)] = [f"e{i}x{at}"] * rng.randrange(1, 2)
            own[len(own) // 2 : len(own) // 2] = passage
        texts.append((i, " ".join(own)))
    hashed = [np.array([hash(w) % 65_521 for w in t.split()], np.uint16) for _, t in texts]
    starts = [next((j for j, w in enumerate(t.split()) if w.startswith("s")), 0) for _, t in texts]
    want = {d for i in range(200) for j in range(i) if passages.similar_stretches(hashed[i], hashed[j], starts[i] - starts[j]) for d in (i, j)}
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [sorted(tuple(r) for r in passages.repeated_passages(frame.repartition(n)).collect()) for n in (1, 50)]
    assert rows[0] == rows[1]
    found = {r[0] for r in rows[0]}
    assert len(found & want) >= 0.97 * len(want) and not found - want


def test_changed_and_inserted_words_keep_a_passage_similar():
    a = np.arange(120, dtype=np.uint16)
    b = a.copy()
    b[60] = 999
    assert passages.similar_stretches(a, b) == [(0, 120, 0, 120)]
    b[::8] = 999
    assert passages.similar_stretches(a, b) == []
    longer = np.insert(a[:60], 30, 999)
    assert passages.similar_stretches(a[:60], longer) == [(0, 60, 0, 61)] and passages.similar_stretches(longer, a[:60]) == [(0, 61, 0, 60)]
    assert passages.similar_stretches(a[:60], np.delete(a[:60], 20), 0) == [(0, 60, 0, 59)]
    assert passages.similar_stretches(a[:49], a[:49]) == [] and passages.similar_stretches(a[:0], a) == []


def test_pii_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        found = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
                good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
                if good:
                    found.append((*m.span(), kind))
        return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rng = random.Random(3)
    parts = ["a", "B", "1", "22", "4111111111111111", "@", ".", "-", "+", " ", "(", ")", "é", "%", "\n", "127.0.0.1", "+1 (838) 555-9577", "x@y.z"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "a." * 100_000) == []


def test_second_mentions_become_spans():
    again = ["", "+1 "]
    texts = [f"at {i} mail user.{i}@mail.example.com, call +1 ({200 + i}) 555-{1000 + i} from 10.0.0.{i % 250}, later {again[i % 2]}({200 + i}) 555-{1000 + i}" for i in range(200)]
    field = pii.Field().fit([pii.Nodes(t, pii.base_spans(t)) for t in texts])
    text = "Call +1 (838) 555-9577 now. Later call 555-9577 again, not 123-4567."
    found = field.added(text, pii.base_spans(text))
    assert [text[a:b] for a, b, _ in found] == ["555-9577"] and found[0][2] == "phone"
    assert field.added("555-9577 and 555-9577", []) == []


def test_time_of_one_text_grows_with_its_length():
    texts = [f"at {i} call +1 ({200 + i}) 555-{1000 + i} from 10.0.0.{i % 250}, later +1 ({200 + i}) 555-{1000 + i}" for i in range(200)]
    field = pii.Field().fit([pii.Nodes(t, pii.base_spans(t)) for t in texts])
    seconds = []
    for n in (2000, 8000):
        text = " ".join(f"call +1 ({200 + i % 700}) 555-{1000 + i} now, later 555-{1000 + i} again." for i in range(n))
        base = pii.base_spans(text)
        begin = time.process_time()
        found = field.added(text, base)
        seconds.append(time.process_time() - begin)
        assert not any(a < d and b > c for a, b, _ in found for c, d, _ in base[:50])
    assert seconds[1] < 8 * seconds[0]


def test_deep_trees_keep_border_pairs():
    rng = np.random.default_rng(7)

    def units(n):
        x = rng.standard_normal((n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sample = units(31_250)
    a, across = sample[:1000], units(1000)
    across -= (across * a).sum(1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * across / np.linalg.norm(across, axis=1, keepdims=True)
    margin = neighbours.SPILL * np.sqrt(2 - 2 * neighbours.MIN_COSINE) / np.sqrt(64) / 2
    leaf, met = iter(range(1, 1 << 31)), np.zeros(1000, bool)
    for _ in range(neighbours.TREES):
        leaves = [set() for _ in range(2000)]
        # a table of 524,288 vectors: ten splits
        for rows, name in neighbours.Tree(sample, 1024 * neighbours.LEAF_ROWS, margin, rng, leaf).route(np.concatenate([a, b])):
            for row in rows.tolist():
                leaves[row].add(name)
        met |= [bool(leaves[i] & leaves[1000 + i]) for i in range(1000)]
    assert met.mean() >= 0.999


def test_every_further_mention_becomes_a_span():
    again = ["", "+1 "]
    texts = [f"at {i} mail user.{i}@mail.example.com, call +1 ({200 + i}) 555-{1000 + i} from 10.0.0.{i % 250}, later {again[i % 2]}({200 + i}) 555-{1000 + i} or user.{i}@example.org" for i in range(200)]
    field = pii.Field().fit([pii.Nodes(t, pii.base_spans(t)) for t in texts])

    def added(text):
        return [(text[a:b], kind) for a, b, kind in field.added(text, pii.base_spans(text))]

    later = "Then call 555-9577 again. "
    assert added("Call +1 (838) 555-9577 now. " + 4 * later) == 4 * [("555-9577", "phone")]
    assert added(3 * later + "Call +1 (838) 555-9577 now. " + later) == 4 * [("555-9577", "phone")]
    assert added("Write to john.smith@example.com now. Later john.smith wrote, so ask (john.smith).") == 2 * [("john.smith", "email")]


def test_chain_marginals_are_exact():
    chain = toxicity.Chain(np.array([5, 9], np.uint64), np.array([2.0, -1.0]), -0.7, np.array([[0.0, -1.2], [0.3, 0.8]]))
    hashes = np.array([1, 5, 2, 3, 9, 5, 1, 1, 1, 5], np.uint64)
    at, kinds = chain.find(hashes)
    weight = {5: 2.0, 9: -1.0}
    forward, backward = [], [np.ones(2)]
    state = np.array([1.0, 0.0])
    emit = [np.array([1.0, np.exp(weight.get(int(h), -0.7))]) for h in hashes]
    for e in emit:
        state = state @ chain.step * e
        forward.append(state)
    for e in emit[:0:-1]:
        backward.append(chain.step @ (e * backward[-1]))
    both = np.array(forward) * np.array(backward[::-1])
    assert np.allclose(chain.marginals(at, kinds, len(hashes)), (both[:, 1] / both.sum(1))[at])


def test_token_ids():
    rng = random.Random(5)
    alphabet = list("aAbB's td'TéÉßİΣσ   .,!12٣½|<>中\U0001f600\t\n\x1f\x85-_") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + [None, ""]
    plain = Tokenizer.from_file(VOCABULARY)
    for text, ids in zip(texts, tokens.Encoder(VOCABULARY).encode(pa.array(texts))):
        assert ids.tolist() == (plain.encode(text, add_special_tokens=False).ids if text else [])


def test_packing_round_trip(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([3, 700, 900, 1400, 5000])))) for i in range(1500)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), VOCABULARY).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    plain = Tokenizer.from_file(VOCABULARY)
    for i, text in texts[:50]:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    bound = packing.lower_bound(got.length.to_numpy())
    assert got.sequence_id.nunique() <= 1.02 * bound


def test_packing_exchanges(spark, monkeypatch):
    """Many small partitions: exchanges take most of what these lose against one partition of all pieces."""
    monkeypatch.setattr(packing, "GROUP", 64)
    monkeypatch.setattr(packing, "EXCHANGE_GROUP", 64)
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(300, 1500)))) for i in range(800)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), VOCABULARY).toPandas()
    assert len(got) == 800 and (got.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    alone = packing.best_fit_decreasing(got.length.to_numpy())[0].max() + 1
    apart = sum(packing.best_fit_decreasing(got.length.to_numpy()[k : k + 64])[0].max() + 1 for k in range(0, 800, 64))
    assert alone <= got.sequence_id.nunique() < apart and got.sequence_id.nunique() <= 1.02 * alone


def test_bound_of_counted_lengths():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 500) // 100 * 100 + 1
    values, counts = np.unique(lengths, return_counts=True)
    order = rng.permutation(len(values))
    assert packing.lower_bound(lengths) == packing.lower_bound(values[order], packing.CAPACITY, counts[order])


def test_bounds_never_exceed_the_best_packing():
    rng = random.Random(1)

    def best(sizes, room):
        if not sizes:
            return len(room)
        options = []
        for k, left in enumerate(room):
            if left >= sizes[0] and left not in room[:k]:
                options.append(best(sizes[1:], room[:k] + [left - sizes[0]] + room[k + 1 :]))
        return min([*options, best(sizes[1:], [*room, 24 - sizes[0]])])

    for _ in range(150):
        sizes = sorted((rng.randrange(1, 25) for _ in range(rng.randrange(1, 8))), reverse=True)
        bins, offsets = packing.best_fit_decreasing(np.array(sizes), 24)
        assert packing.lower_bound(np.array(sizes), 24) <= best(sizes, []) <= bins.max() + 1
        assert all(sum(s for s, b in zip(sizes, bins) if b == k) <= 24 for k in set(bins))


def test_zip64_and_packages_without_an_index():
    raw = io.BytesIO()
    records = [warc.record(i, "u", b"x" * i, None if i % 2 else 7) for i in range(20)]
    packed = [zlib.compressobj(6, zlib.DEFLATED, 31) for _ in records]
    body = b"".join(p.compress(r) + p.flush() for p, r in zip(packed, records))
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(66_000):
            z.writestr(f"empty/{i}", b"")
        with z.open("archive/one.warc.gz", "w", force_zip64=True) as f:
            f.write(body)
        z.comment = b"PK\x05\x06 no end"
    size = raw.getbuffer().nbytes
    assert b"PK\x06\x06" in raw.getvalue()
    members = warc.central_directory(raw, size)
    assert len(members) == 66_001
    rows = [warc.parse_record(zlib.decompress(raw.getvalue()[a : a + n], 31)) for a, n in warc.record_ranges(raw, size)]
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in rows] == [(i, i, None if i % 2 else 7) for i in range(20)]


def test_archives_are_read_in_parts(spark, monkeypatch):
    """Partitions of the read-back follow the packages' bytes, whatever adaptive execution thinks of the small ranges."""
    monkeypatch.setattr(warc, "READ_BLOCK", 20_000)
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", rng.randbytes(800).hex()) for i in range(300)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).select("page_id", "payload", F.spark_partition_id().alias("part")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: html for i, _, html in pages}
    assert len({r.part for r in got}) >= 5


def plain_filters(rows, languages):
    """N-grams of three and four bytes that each language's filter takes."""
    clean = lambda t: bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in t.encode())
    out = {}
    for n in langid.SIZES:
        counts = {k: Counter() for k in languages}
        for lang, text in rows:
            b = clean(text)
            counts[lang].update(g for g in (b[i : i + n] for i in range(len(b) - n + 1)) if g != b" " * n)
        share = {k: {g: c / counts[k].total() for g, c in counts[k].items()} for k in languages}
        for k in languages:
            out[n, k] = {g for g, c in counts[k].items() if c >= langid.LEAST and share[k][g] >= langid.SHARE * max(share[j].get(g, 0) for j in languages)}
    return out


def test_language_filters(spark):
    rng = random.Random(8)
    words = {"x": ["alpha", "beta", "Gamma!"], "y": ["alpha", "été", "über"], "z": ["beta", "wörd"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate(rng.choice("xxxyyz") for _ in range(300))]
    docs += [(None, "alpha", "x"), (7000, None, "x"), (7001, "beta", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    languages, _ = langid.sample(df)
    known = [(lang, text) for i, text, lang in docs if i is not None and text is not None and lang and zlib.crc32(str(i).encode()) % 3 != 1]
    sizes = Counter(lang for lang, _ in known)
    assert languages == sorted(sizes, key=lambda k: (-sizes[k], k))
    filters, wanted = langid.train(df), plain_filters(known, languages)
    for n in langid.SIZES:
        for k, lang in enumerate(languages):
            plain = langid.Filters(languages)
            plain.insert(n, k, np.array([int.from_bytes(g, "big") for g in wanted[n, lang]], np.uint64))
            assert wanted[n, lang] and (((filters.slices[n][0] ^ plain.slices[n][0]) >> k) & 1).sum() == 0
    # equal shares: the more frequent language comes first
    assert langid.identify(spark.createDataFrame([(1, "qqqq")], "doc_id long, text string"), filters).first().lang_pred == languages[0]


def test_language_sample_has_a_limit(spark):
    """An id that most rows share fills no more than twice the wanted rows, and rare languages beyond the limit are left out."""
    rows = [(0, f"text {i}", "x") for i in range(5000)] + [(i, f"word {i}", "y") for i in range(1, 3000)] + [(0, "one", "z")]
    _, sampled = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4000, most=2)
    assert {r.language: r["count"] for r in sampled.groupBy("language").count().collect()}.keys() == {0, 1}
    languages, sampled = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=1500, most=2)
    assert languages == ["x", "y"] and all(r["count"] <= 3000 for r in sampled.groupBy("language").count().collect())
