"""Operators 11 to 13 against plain code: sizes, ties, nulls, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameops.llm import lexical, nearest, trie


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    hashed = lambda x: hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()
    turns = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, hashed(x)))] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = {}
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        childless = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under)]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        children = sum(len(m) == len(node) + 1 for m in under)
        parent = min(members[node[:-1]]) if node else None
        out[min(convs), len(node)] = (parent, len(convs), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def talk(rng, n):
    """Conversations that share first turns, one long chain and its copies, one with null turns, repeated rows."""
    rows = []
    for c in range(n):
        kind = rng.random()
        length = rng.randrange(1, 9) if kind < 0.8 else 25
        rows += [(c, t, rng.choice(["user", None]) if kind > 0.9 else "user", f"turn {t} {rng.randrange(1 + t) if kind < 0.5 else 0}" if t % 7 else None) for t in range(length)]
    rows += [(n + 4, None, "a", "é"), (n + 4, None, None, None), (None, 1, "a", "b"), (3, 1, "user", "again"), (3, 1, "user", "again")]
    return rows


@pytest.mark.parametrize("n,task_weight", [(40, 4096), (40, 1), (120, 30)])
def test_trie(spark, n, task_weight):
    rows = talk(random.Random(n), n)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.prefix_trie(df, task_weight).collect()}
    assert got == plain_trie(rows)


def test_trie_chain(spark):
    """A chain of 3,000 turns that two conversations share: rounds grow with the digits of its weight only."""
    rows = [(c, t, "user", f"t{t}") for c in (0, 1) for t in range(3000)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 500)
    got = got.groupBy().agg(F.count("*"), F.max("n_leaves"), F.max("saved_tokens"), F.max("depth")).first()
    assert tuple(got) == (3001, 1, sum(len(f"t{t}") for t in range(3000)), 3000)


def test_trie_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_nearest(rows, k):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in sound:
        if q % 20 == 0:
            found = [(-nearest._inner(a[None], b[None])[0], i) for i, b in sound if i != q and len(a) == len(b)]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("cells,share", [(2_000_000, 1024), (200, 4)])
def test_nearest(spark, monkeypatch, cells, share):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 12)).astype(np.float32)
    vectors[50:90] = vectors[40]
    vectors[100:140] = vectors[41] + rng.standard_normal((40, 12)).astype(np.float32) * 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(400, None), (420, []), (440, [0.0] * 12), (460, [1.0, None] + [0.0] * 10), (480, [float("nan")] * 12), (None, [1.0] * 12), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (520, [1.0] * 13)]
    rows += [(301, vectors[3].tolist()), (302, (vectors[4] * 1e30).tolist()), (303, (vectors[4] * 1e-30).tolist())]
    monkeypatch.setattr(nearest, "QUERY_CELLS", cells)
    monkeypatch.setattr(nearest, "STRIPE_SHARE", share)
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == plain_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert len(got) == len(set(got)) and nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.5])]
    got = sorted(tuple(r) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 2).collect())
    assert got == [(20, 1, 7, 1.0), (20, 1, 7, 1.0), (20, 2, 7, 1.0), (20, 2, 7, 1.0)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def texts(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "C1 r7 É " * 5000), (n + 4, "ÉTÉ x_y")]
    docs += [(n + 10 + i, docs[5][1]) for i in range(60)]
    items = [(i, " ".join(rng.choice(common + rare) for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    return docs, items + [(0, "c1 r7"), (None, "c2 c2 r9"), (90, None), (91, "..."), (92, "nowhere"), (93, "É c1"), (94, docs[5][1])]


@pytest.mark.parametrize("cells,group_items,block", [(16_000_000, 1024, 32), (4000, 1024, 4), (16_000_000, 7, 2)])
def test_lexical(spark, monkeypatch, cells, group_items, block):
    docs, items = texts(random.Random(2), 300)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", group_items)
    search = lexical._search
    # the workers import the module themselves: sizes travel with the function

    def small(model, k, batches):
        lexical.SHARD_CELLS, lexical.BLOCK_ROWS = cells, block
        yield from search(model, k, batches)

    monkeypatch.setattr(lexical, "_search", small)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, rank int").repartition(3)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int").repartition(2)
    got = sorted((tuple(r) for r in lexical.search(d, q).collect()), key=str)
    assert got == plain_search(docs, items)


def test_lexical_empty(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0 and lexical.search(d, q.where("item_id = 2")).count() == 0
    assert [tuple(r) for r in lexical.search(d, q).collect()] == plain_search([(1, "a")], [(1, "a"), (2, None)])
