"""Token ids of whole texts with a word cache in front of a ``tokenizers`` vocabulary.

The vocabulary's normalizer works on single characters and its splitter drops white space, so a text's ids are those of its
chunks between ASCII white space, one after another. Each distinct chunk of a worker goes through the library once and its ids
stay in flat arrays; when the cache is full it starts anew. A text that may hold a special token is encoded whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from frameops.llm import words as W

#: Chunks a worker keeps, and words it keeps for chunks that differ in punctuation only.
CACHE_CHUNKS, CACHE_WORDS = 1_000_000, 200_000


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        splitter = self.tokenizer.pre_tokenizer
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.split = splitter.pre_tokenize_str
        # plain words take the model alone: the splitter leaves them whole, and bytes stand for themselves
        self.plain = regex.compile(r"([a-z]+)([!#$%&*+,./:;<=>?@^_`|~-]*)", regex.ASCII)
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.size, self.ids, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0
        self.words: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        found = self.words.get(text)
        if found is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            found = self.words[text] = [t.id for t in self.model.tokenize(text)]
        return found

    def chunk(self, raw: bytes) -> list[int]:
        text = raw.decode()
        if raw.isascii():
            if whole := self.plain.fullmatch(text.lower()):
                word, marks = whole.groups()
                return self.word(word) + self.word(marks) if marks else self.word(word)
        return [i for part, _ in self.split(self.normalize(text)) for i in self.word(part)]

    def _learn(self, w: W.Words, hashes: np.ndarray, at: np.ndarray) -> None:
        """Add the chunks ``hashes``, sorted, which begin at the words ``at``."""
        data = w.data.tobytes()
        found = [self.chunk(data[a:b]) for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        first = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        self.used += total
        place = np.searchsorted(self.hash, hashes)
        self.hash, self.first, self.size = np.insert(self.hash, place, hashes), np.insert(self.first, place, first), np.insert(self.size, place, size)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; none for a null text."""
        for low, high, w in W.each_chunk(column, "space"):
            distinct, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(self.hash) + len(distinct) > CACHE_CHUNKS:
                self.clear()
            place = np.searchsorted(self.hash, distinct)
            known = np.zeros(len(distinct), bool)
            inside = place < len(self.hash)
            known[inside] = self.hash[place[inside]] == distinct[inside]
            if not known.all():
                self._learn(w, distinct[~known], at[~known])
                place = np.searchsorted(self.hash, distinct)
            place = place[inverse]
            size, first = self.size[place], self.first[place]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.ids[np.repeat(first - (ends - size), size) + np.arange(total)]
            bound = np.concatenate([[0], ends])[w.first]
            for i in range(high - low):
                raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                if any(s in raw for s in self.specials):
                    yield np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield flat[bound[i] : bound[i + 1]]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)
