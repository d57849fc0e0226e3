"""Toxic spans by a linear-chain conditional random field over the words of a text.

Training fits on a bounded sample of labelled rows (``TRAIN_DOCS`` for each label). Labels belong to documents, so words are
labelled first: a word type counts by its distinct (word before, word after) contexts, so that copies of one document count
once, and types whose log-odds in toxic documents are high with certainty are toxic where they stand in a toxic document. The
chain has two states. Its parameters are a weight for each known type, one for all other words, and the transitions; gradient
ascent on windows of labelled words fits them by forward-backward.

Scoring runs over every whole text. Words of no known type share one transfer matrix, so a run of them is a power of it in
closed form and forward-backward only stops at known words; the marginals are exact. A document's score is a logistic function,
fitted on the sample, of the expected evidence -sum(log(1 - p)) and of the largest marginal. Offending offsets are those of
words with a marginal of at least 0.5.

Defined results: a null or empty text has no spans and the score of no evidence; labels that are null are no labels, and of
repeated labels the largest counts; without labelled rows of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm import words as W
from frameops.llm.rows import add_columns

#: Labelled documents of each kind that training reads; threshold of a prediction.
TRAIN_DOCS, REJECT = 2000, 0.7
WINDOW, STEPS = 9, 150
_EVIDENCE_LIMIT = 20.0


def fold(doc_id):
    """Remainder that tells held-out rows (1) from the others."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_kind: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``per_kind`` rows of each kind that are not held out, in a hash order of their ids."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("kind"))
    order = F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")
    chosen = known.where("kind = 1").orderBy(*order).limit(per_kind).union(known.where("kind = 0").orderBy(*order).limit(per_kind))
    # at most 2 * per_kind ids
    rows = docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "text", "kind").dropDuplicates(["doc_id"])
    return [(r.text, r.kind) for r in rows.orderBy("doc_id").toLocalIterator()]


class Chain:
    """Parameters of the chain, and marginals of known words."""

    def __init__(self, types: np.ndarray, weights: np.ndarray, other: float, transitions: np.ndarray) -> None:
        self.types, self.weights, self.other = types, weights, other
        self.step = np.exp(transitions)
        rest = self.step * np.array([1.0, np.exp(other)])
        values, left = np.linalg.eig(rest)
        order = np.argsort(-values.real)
        self.ratio = float((values[order[1]] / values[order[0]]).real)
        basis = left[:, order].real
        inverse = np.linalg.inv(basis)
        self.lead, self.second = np.outer(basis[:, 0], inverse[0]), np.outer(basis[:, 1], inverse[1])
        self.score = np.zeros(3)

    def run(self, n: int) -> np.ndarray:
        """Transfer matrix over n words of no known type, up to a factor."""
        return self.lead + self.second * self.ratio**n

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known words and their types."""
        if not len(self.types):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.types, hashes), len(self.types) - 1)
        at = np.flatnonzero(self.types[place] == hashes)
        return at, place[at]

    def marginals(self, at: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
        """Probability of the toxic state at the known words ``at`` of a text of n words."""
        gaps = np.diff(np.concatenate([[-1], at])) - 1
        emit = np.stack([np.ones(len(at)), np.exp(self.weights[kinds])], 1)
        forward, backward = np.zeros((len(at), 2)), np.ones((len(at), 2))
        state = np.array([1.0, 0.0])
        for i, gap in enumerate(gaps.tolist()):
            state = (state @ (self.run(gap) if gap else np.eye(2))) @ self.step * emit[i]
            forward[i] = state = state / state.sum()
        tail = n - 1 - int(at[-1])
        after = (self.run(tail) if tail else np.eye(2)) @ np.ones(2)
        for i in range(len(at) - 1, -1, -1):
            backward[i] = after / after.sum()
            after = self.step @ (emit[i] * backward[i])
            after = (self.run(int(gaps[i])) if gaps[i] else np.eye(2)) @ after
        both = forward * backward
        return both[:, 1] / both.sum(1)

    def features(self, p: np.ndarray) -> list[float]:
        return [min(float(-np.log1p(-np.minimum(p, 1 - 1e-9)).sum()), _EVIDENCE_LIMIT), float(p.max())] if len(p) else [0.0, 0.0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.score[0] + features @ self.score[1:])))


def _toxic_types(sample: list[tuple[W.Words, np.ndarray]], toxic_docs: int) -> np.ndarray:
    contexts = []
    for w, kinds in sample:
        doc = W.doc_of(w)
        before, after = np.roll(w.hash, 1), np.roll(w.hash, -1)
        before[w.first[:-1][w.first[:-1] < len(doc)]] = 0
        ends = w.first[1:][w.first[1:] > 0] - 1
        after[ends] = 0
        context = W.mix(before * np.uint64(3) + after * np.uint64(5))
        contexts.append(np.stack([w.hash, context, kinds[doc].astype(np.uint64)], 1))
    rows = np.unique(np.concatenate(contexts), axis=0) if contexts else np.zeros((0, 3), np.uint64)
    types, place = np.unique(rows[:, 0], return_inverse=True)
    toxic = np.bincount(place, weights=rows[:, 2] == 1, minlength=len(types)) + 0.5
    clean = np.bincount(place, weights=rows[:, 2] == 0, minlength=len(types)) + 0.5
    odds = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    sure = odds - np.sqrt(1 / toxic + 1 / clean)
    return types[(sure >= 1) & (toxic >= max(4, toxic_docs / 200))]


def _windows(types: np.ndarray, sample: list[tuple[W.Words, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Type indices (0: none) and word labels of windows around known words, and of as many other windows."""
    chain = Chain(types, np.zeros(len(types)), 0.0, np.zeros((2, 2)))
    rng = np.random.default_rng(11)
    shapes, marks = [], []
    for w, kinds in sample:
        n = len(w.hash)
        if n < WINDOW:
            continue
        index = np.zeros(n, np.int64)
        at, place = chain.find(w.hash)
        index[at] = place + 1
        label = (index > 0) & (kinds[W.doc_of(w)] == 1)
        begin = np.concatenate([at - WINDOW // 2, rng.integers(0, n - WINDOW + 1, max(50, len(at)))])
        begin = np.clip(begin, 0, n - WINDOW)[:, None] + np.arange(WINDOW)
        shapes.append(index[begin])
        marks.append(label[begin])
    return (np.concatenate(shapes), np.concatenate(marks)) if shapes else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), bool))


def _fit_chain(types: np.ndarray, shapes: np.ndarray, marks: np.ndarray) -> Chain:
    """Gradient ascent on the mean log-likelihood of the windows, with a small ridge."""
    weights, moves = np.zeros(len(types) + 1), np.zeros((2, 2))
    sums = np.zeros(len(weights)), np.zeros((2, 2))
    n, length = shapes.shape
    y = marks.astype(np.int64)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    seen = np.bincount(shapes.ravel(), weights=y.ravel(), minlength=len(weights))
    for _ in range(STEPS):
        emit = np.stack([np.ones((n, length)), np.exp(weights[shapes])], 2)
        step = np.exp(moves)
        forward, backward = np.zeros((n, length, 2)), np.ones((n, length, 2))
        scale = np.ones((n, length))
        for t in range(length):
            state = emit[:, 0] * step[0] if t == 0 else (forward[:, t - 1] @ step) * emit[:, t]
            scale[:, t] = state.sum(1)
            forward[:, t] = state / scale[:, t, None]
        for t in range(length - 2, -1, -1):
            backward[:, t] = (emit[:, t + 1] * backward[:, t + 1]) @ step.T / scale[:, t + 1, None]
        p = (forward * backward)[:, :, 1]
        expected = np.bincount(shapes.ravel(), weights=p.ravel(), minlength=len(weights))
        both = np.einsum("ntx,nty->xy", forward[:, :-1], emit[:, 1:] * backward[:, 1:] / scale[:, 1:, None]) * step
        for value, total, slope in ((weights, sums[0], (seen - expected) / n - 1e-4 * weights), (moves, sums[1], (seen_moves - both) / n - 1e-4 * moves)):
            total += slope**2
            value += 0.5 * slope / np.sqrt(total + 1e-12)
    return Chain(types, weights[1:], float(weights[0]), moves)


def _fit_score(features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (kinds - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, per_kind: int = TRAIN_DOCS) -> Chain:
    rows = training_rows(docs, labels, "toxic", per_kind)
    kinds = np.array([kind for _, kind in rows], np.int64)
    sample = [(w, kinds[low:high]) for low, high, w in W.each_chunk(pa.array([t for t, _ in rows], pa.large_string()), "alnum")]
    toxic = int(kinds.sum())
    types = _toxic_types(sample, toxic) if 0 < toxic < len(kinds) else np.zeros(0, np.uint64)
    shapes, marks = _windows(types, sample)
    chain = _fit_chain(types, shapes, marks) if len(types) and len(shapes) else Chain(types[:0], np.zeros(0), 0.0, np.array([[0.0, -3.0], [0.0, 0.0]]))
    share = (toxic + 0.5) / (len(kinds) + 1)
    chain.score = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if len(chain.types):
        features = np.array([chain.features(p) for w, _ in sample for p, _ in _each_text(chain, w)])
        # the sample holds toxic rows more often than the labels do; both kinds keep the weight they have in it
        chain.score = _fit_score(features, kinds)
    return chain


def _each_text(chain: Chain, w: W.Words):
    at, kinds = chain.find(w.hash)
    bounds = np.searchsorted(at, w.first)
    for i in range(len(w.first) - 1):
        own = slice(bounds[i], bounds[i + 1])
        n = int(w.first[i + 1] - w.first[i])
        yield (chain.marginals(at[own] - w.first[i], kinds[own], n) if own.start < own.stop else np.zeros(0)), at[own]


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans: code point offsets of offending words and their marginals."""
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def compute(batch: pa.RecordBatch) -> dict[str, list]:
        chain = model.value
        features, spans = [], []
        for _, _, w in W.each_chunk(batch.column(batch.schema.get_field_index(text_col)), "alnum"):
            for i, (p, at) in enumerate(_each_text(chain, w)):
                features.append(chain.features(p))
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    points = np.cumsum((w.data[w.offsets[i] : w.offsets[i + 1]] & 0xC0) != 0x80)
                    start, end = w.start[at[bad]] - w.offsets[i], w.end[at[bad]] - w.offsets[i]
                    spans.append([{"start": int(points[s] - 1), "end": int(points[e - 1]), "probability": float(q)} for s, e, q in zip(start, end, p[bad])])
                else:
                    spans.append([])
        return {"toxicity": chain.probability(np.array(features).reshape(-1, 2)), "toxic_spans": spans}

    return add_columns(docs, "toxicity double, toxic_spans array<struct<start: long, end: long, probability: double>>", compute)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= REJECT).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))
