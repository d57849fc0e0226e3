"""Personal data: exact patterns, and a skip-chain conditional random field that adds what repeats them.

Base spans are those of four patterns over the whole text. Nodes of the field are the tokens between white space that hold a
digit or an at sign or are the name before the at sign of an address in the text, labelled with a kind or as other. Neighbouring
tokens share a chain potential. Tokens that repeat, or that share a run of at least four digits or the name before an at sign,
share a skip potential with the one before them and with the nearest ones in base spans on both sides, however far away. Loopy
message passing finds the marginals of each document. A token outside all base spans becomes a span when its marginal for a kind
reaches ``ADD`` and skip edges join it, over any number of tokens, to one in a base span of that kind. So every further mention
without its prefix is found, and a document without base spans never gets any.

Weights are fitted by pseudo-likelihood on a bounded sample of documents (``TRAIN_DOCS``), with the base spans as labels and with
token features left out at random, so that the edges carry weight of their own. Tokens that repeat a part of a base span
elsewhere have no label there. Names of addresses in other documents of the sample are nodes there, labelled as other, so that
plain words that are names elsewhere have evidence against them.

Defined results: a null or empty text has no spans; repeated rows are read one by one; every pattern takes time linear in the
length of the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameops.llm.rows import add_columns, hash_sample

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, ADD = 10_000, 0.9
_FEATURES, _ROUNDS = 1 << 12, 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _NODE, _TOKEN = re.compile("[0-9]"), re.compile("[0-9@]"), re.compile(r"\S+")

Span = tuple[int, int, str]


def _emails(text: str) -> list[Span]:
    """An address starts where its run of name characters does, or where the one before ended; its at sign decides the rest."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done, "email"))
        at = text.find("@", max(done, at + 1))
    return found


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of all patterns, by start and then kind."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(token: str) -> str:
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", token[:64])))


def _core(raw: str) -> tuple[int, str]:
    """A token without the punctuation around it, and where that starts in the token."""
    core = raw.lstrip("\"'([{<,;:!?*#%&$|.")
    return len(raw) - len(core), core.rstrip("\"')]}>,;:!?*#%&$|.")


def _names(text: str, emails: list[Span]) -> set[str]:
    """Names before the at signs of addresses, as they stand alone."""
    return {_core(text[a : text.index("@", a)].lower())[1] for a, _, kind in emails if kind == "email"} - {""}


class Nodes:
    """Nodes, edges and base labels of one text. Tokens equal to one of ``names`` are nodes too."""

    def __init__(self, text: str, base: list[Span], names: frozenset[str] = frozenset()) -> None:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        names = names | _names(text, base)
        place = [i for i, (a, b) in enumerate(tokens) if _NODE.search(text, a, b) or names and _core(text[a:b].lower())[1] in names]
        self.spans = []
        features, chain = [], []
        holders: dict[str, list[int]] = {}
        for node, i in enumerate(place):
            raw = text[slice(*tokens[i])]
            skipped, core = _core(raw)
            start = tokens[i][0] + skipped
            self.spans.append((start, start + len(core)))
            around = [_shape(text[slice(*tokens[j])]) if 0 <= j < len(tokens) else "" for j in (i - 1, i + 1)]
            shape = _shape(core)
            features.append([zlib.crc32(f.encode()) % _FEATURES for f in (f"s{shape}", f"p{around[0]}", f"n{around[1]}", f"d{min(sum(c.isdigit() for c in core), 20)}", f"b{around[0]}|{shape}", f"m{shape[:3]}")])
            if node and place[node - 1] == i - 1:
                chain.append((node - 1, node))
            keys = {core.lower()} | set(re.findall(r"[0-9]{4,}", core)) | ({core.lower().split("@")[0]} | _names(raw, _emails(raw)) if "@" in core else set())
            for key in keys:
                holders.setdefault(key, []).append(node)
        self.features = np.array(features, np.int64).reshape(-1, 6)
        self.label = np.zeros(len(place), np.int64)
        starts = np.array([s for s, _ in self.spans], np.int64)
        self.covered = np.zeros(len(place), bool)
        lows, highs = (np.searchsorted(starts, np.array([s[i] for s in base], np.int64) - back).tolist() for i, back in ((0, 8), (1, 0)))
        for (a, b, kind), low, high in zip(base, lows, highs):
            for node in range(low, high):
                x, y = self.spans[node]
                if x < b and y > a:
                    self.covered[node] = True
                    self.label[node] = 1 + KINDS.index(kind)
        skips = set()
        for nodes in holders.values():
            skips.update(zip(nodes, nodes[1:]))
            for ordered in (nodes, nodes[::-1]):
                inside = None
                for node in ordered:
                    if self.covered[node]:
                        inside = node
                    elif inside is not None:
                        skips.add((min(inside, node), max(inside, node)))
        self.chain, self.skips = (np.array(e, np.int64).reshape(-1, 2) for e in (chain, sorted(skips)))
        #: kinds of base spans that skip edges join each token outside to, however many lie between
        self.partner = self._partners()
        #: such a token has no known label: it is what the field has to decide
        self.known = np.ones(len(place), bool)
        self.known[list(self.partner)] = False

    def _partners(self) -> dict[int, set[int]]:
        parent = list(range(len(self.label)))

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for a, b in self.skips.tolist():
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        kinds: dict[int, set[int]] = {}
        for node in np.flatnonzero(self.covered).tolist():
            kinds.setdefault(root(node), set()).add(int(self.label[node]))
        return {node: kinds[r] for node in np.flatnonzero(~self.covered).tolist() if (r := root(node)) in kinds}


class Field:
    """Weights of token features by label, of the chain and of the skip edges."""

    def __init__(self) -> None:
        n = len(KINDS) + 1
        self.token, self.chain = np.zeros((_FEATURES, n)), np.zeros((n, n))
        # before any evidence, repeats lean to one label
        self.skip = 2 * np.eye(n)

    def fit(self, docs: list[Nodes], steps: int = 80) -> Field:
        """Gradient ascent on the pseudo-likelihood of the tokens with known labels."""
        docs = [d for d in docs if len(d.label)]
        if not docs:
            return self
        first = np.cumsum([0] + [len(d.label) for d in docs])
        features, label = np.concatenate([d.features for d in docs]), np.concatenate([d.label for d in docs])
        chain, skip = (np.concatenate([getattr(d, name) + at for d, at in zip(docs, first)]) for name in ("chain", "skips"))
        known = np.concatenate([d.known for d in docs])
        chain, skip = (edges[known[edges].all(1)] for edges in (chain, skip))
        rng = np.random.default_rng(5)
        n = self.chain.shape[0]
        sums = [np.full(w.shape, 1e-8) for w in (self.token, self.chain, self.skip)]
        truth = np.eye(n)[label]
        for _ in range(steps):
            kept = rng.random(features.shape) < 0.5
            logits = (self.token[features] * kept[:, :, None]).sum(1)
            for edges, weight in ((chain, self.chain), (skip, self.skip)):
                np.add.at(logits, edges[:, 1], weight[label[edges[:, 0]]])
                np.add.at(logits, edges[:, 0], weight.T[label[edges[:, 1]]])
            p = np.exp(logits - logits.max(1, keepdims=True))
            miss = (truth - p / p.sum(1, keepdims=True)) * known[:, None]
            slopes = [np.zeros_like(w) for w in (self.token, self.chain, self.skip)]
            for k in range(features.shape[1]):
                np.add.at(slopes[0], features[:, k], miss * kept[:, k, None])
            for slope, edges in ((slopes[1], chain), (slopes[2], skip)):
                np.add.at(slope, label[edges[:, 0]], miss[edges[:, 1]])
                np.add.at(slope.T, label[edges[:, 1]], miss[edges[:, 0]])
            for weight, total, slope in zip((self.token, self.chain, self.skip), sums, slopes):
                slope -= 0.01 * weight
                total += slope**2
                weight += 0.3 * slope / np.sqrt(total)
        return self

    def marginals(self, d: Nodes) -> np.ndarray:
        """Loopy sum-product with damping; base labels are held fixed."""
        unary = self.token[d.features].sum(1)
        unary[d.covered] = -50.0
        unary[d.covered, d.label[d.covered]] = 50.0
        edges = np.concatenate([d.chain, d.skips])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        weight = np.concatenate([np.repeat(self.chain[None], len(d.chain), 0), np.repeat(self.skip[None], len(d.skips), 0)])
        weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        messages = np.zeros((2 * m, unary.shape[1]))
        belief = unary.copy()
        for _ in range(_ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            sent = (belief[source] - messages[back])[:, :, None] + weight
            top = sent.max(1)
            sent = top + np.log(np.exp(sent - top[:, None]).sum(1))
            messages = 0.5 * messages + 0.5 * (sent - sent.max(1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, target, messages)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if not base:
            return []
        d = Nodes(text, base)
        if not d.partner:
            return []
        p = self.marginals(d)
        ordered = sorted(base)
        starts, ends = (np.array([s[i] for s in ordered], np.int64) for i in (0, 1))
        furthest = np.maximum.accumulate(ends)
        found = []
        for node in sorted(d.partner):
            kind = int(p[node].argmax())
            start, end = d.spans[node]
            # of the spans that begin before the token ends, one ends behind its start
            before = int(np.searchsorted(starts, end))
            meets = before > 0 and furthest[before - 1] > start
            if kind in d.partner[node] and p[node, kind] >= ADD and end > start and not meets:
                found.append((start, end, KINDS[kind - 1]))
        return found


def train(docs: DataFrame, sample: int = TRAIN_DOCS) -> Field:
    """Fit on the documents with a digit or an at sign in a hash sample of ``sample`` documents."""
    rows = hash_sample(docs.select("doc_id", "text"), sample, 3, F.col("text").rlike("[0-9@]"))
    texts = [(r.text, base_spans(r.text)) for r in rows.toLocalIterator()]
    names = frozenset().union(*(_names(text, base) for text, base in texts))
    return Field().fit([Nodes(text, base, names) for text, base in texts])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _with_spans(docs: DataFrame, field: Field, text_col: str, added: str, make: Callable[[str, list[Span], list[Span]], tuple]) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(field)
    names = [part.split()[0] for part in added.split(", ")]

    def compute(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for value in batch.column(batch.schema.get_field_index(text_col)):
            text = value.as_py() or ""
            base = base_spans(text)
            every = sorted(base + model.value.added(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
            rows.append(make(text if value.is_valid else None, base, every))
        return dict(zip(names, map(list, zip(*rows))))

    return add_columns(docs, added, compute)


def mask(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and n_spans; overlapping spans are replaced together by the first kind."""

    def make(text: str | None, base: list[Span], spans: list[Span]) -> tuple:
        if not spans:
            return text, 0
        out, done = [], 0
        for start, end, kind in spans:
            if start >= done:
                out += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join(out) + text[done:], len(spans)

    return _with_spans(docs, field, text_col, f"{text_col} string, n_spans long", make)


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""

    def make(text: str | None, base: list[Span], spans: list[Span]) -> tuple:
        counts = [sum(s[2] == kind for s in base) for kind in KINDS]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    names = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _with_spans(docs.select("doc_id", "text"), train(docs), "text", names, make).drop("text")
