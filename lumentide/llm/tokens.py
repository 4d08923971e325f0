"""Fast exact encoding with public tokenizer files.

The word tokenizer drops white space and never joins what white space parts, so a text's
ids are those of its words in a row; words are encoded once for each worker and kept in a
bounded cache as packed 16-bit ids.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

from lumentide.llm.textio import Words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


class WordTokenizer:
    """Ids equal to those of the tokenizers library without special tokens, for blocks of texts.

    A word of letters with one mark behind at most is a stem and a mark. Stems are hashed
    by numpy, looked up once for each block, and new ones are encoded many in one text and
    parted at the word ends. Other words are encoded each by itself. Texts with a special
    token's string or a joining mark are encoded whole.
    """

    def __init__(self, path: str, cache_words: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        size = self.inner.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.limit = cache_words
        self.specials = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        bare = json.loads(self.inner.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))  # for lower-case ASCII words, which the normaliser leaves alone
        self.last = np.zeros(size, bool)
        self.last[[i for t, i in self.inner.get_vocab().items() if t.endswith("</w>")]] = True
        self.marks = np.full(256, -1, np.int64)
        for m in ".,":
            self.marks[ord(m)] = self.inner.token_to_id(m + "</w>") if self.inner.token_to_id(m + "</w>") is not None else -1
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.begin, self.used = np.zeros(1 << 20, np.uint16), np.zeros(1, np.int64), 0

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _parted(self, inner, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        parts, counts = [], []
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            ids = np.array(inner.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint16)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                each = self._encode(some)
                ids, ends = np.array([i for x in each for i in x], np.uint16), np.cumsum([len(x) for x in each])
            parts.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(parts or [np.zeros(0, np.uint16)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        plain, wide, odd = [], [], []
        for k, w in zip(keys, words, strict=True):
            kind = plain if w.isalpha() else wide if not w.isascii() and w.decode().isalpha() else odd
            kind.append((k, w))
        each = self._encode([w for _, w in odd])
        sets = [(plain, *self._parted(self.bare, [w for _, w in plain])), (wide, *self._parted(self.inner, [w for _, w in wide]))]
        sets.append((odd, np.array([i for x in each for i in x], np.uint16), np.array([len(x) for x in each], np.int64)))
        for names, ids, counts in sets:
            if not names:
                continue
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint16)))
            self.flat[self.used : self.used + len(ids)] = ids
            base = len(self.begin) - 1
            self.begin = np.concatenate((self.begin, self.used + np.cumsum(counts)))
            self.used += len(ids)
            self.slots.update(zip((k for k, _ in names), range(base, base + len(names))))

    def encode_block(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and for each text where its ids begin; one more bound at the end."""
        whole = [i for i, t in enumerate(texts) if t and self._crosses(t)]
        if whole:
            apart = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
            ids, bounds = self.encode_block([None if i in apart else t for i, t in enumerate(texts)])
            pieces = [np.array(apart[i], np.uint16) if i in apart else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        words = Words(texts)
        if not len(words):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        buf = _LOWER[words.buf]
        # a mark behind a letter is a token of its own; behind another mark it may join it
        last, before = buf[words.ends - 1], buf[np.maximum(words.ends - 2, 0)]
        mark = np.where((words.ends - words.starts > 1) & _LETTER[before], self.marks[last], -1)
        words.buf, words.ends = buf, words.ends - (mark >= 0)
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.slots) > self.limit:
            self._forget()
        names = keys.tolist()
        slots = np.fromiter((self.slots.get(k, -1) for k in names), np.int64, len(names))
        if (new := np.flatnonzero(slots < 0)).size:
            data, at = buf.tobytes(), first[new]
            self._learn([names[k] for k in new.tolist()], [data[b:e] for b, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)])
            slots[new] = np.fromiter((self.slots[names[k]] for k in new.tolist()), np.int64, len(new))
        slot = slots[inverse]
        begin, size = self.begin[slot], self.begin[slot + 1] - self.begin[slot]
        ends = np.cumsum(size + (mark >= 0))
        total = int(ends[-1])
        at = ends - size - (mark >= 0)
        ids = np.empty(total, np.uint16)
        stem_at = np.repeat(at - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        ids[stem_at] = self.flat[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))]
        ids[ends[mark >= 0] - 1] = mark[mark >= 0]
        return ids, np.concatenate(([0], ends))[words.bounds]

    def _crosses(self, text: bytes) -> bool:
        """Whether ids may depend on more than a word: a special token's string, or a mark that may join a space's other side."""
        if any(s in text for s in self.specials):
            return True
        return not text.isascii() and any(0x300 <= ord(c) < 0x370 for c in set(text.decode()))


class ByteTokenizer:
    """A byte-level vocabulary of ranks; tokens joined are the text's bytes, so their spans are running sums."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.inner = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)

    def encode_spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte offset where each token ends."""
        ids = np.array(self.inner.encode_ordinary(text.decode()), np.int64)
        return ids, np.cumsum(self.widths[ids])


_held: dict[tuple, object] = {}


def held(kind: type, *args):
    """One instance for each worker process, so that caches outlive a task."""
    if (kind, *args) not in _held:
        _held[(kind, *args)] = kind(*args)
    return _held[(kind, *args)]
