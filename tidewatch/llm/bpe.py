"""Byte-pair encoding with a public vocabulary, by a segment tree over the ranks of adjacent pairs.

A word's symbols are its bytes; the leaf i of its tree holds the rank of symbol i with the next, joined with i, so the
root's minimum is the leftmost pair of the lowest rank. A merge changes three leaves (its own, the right symbol's and the
left neighbour's), each a path of log n nodes. It ends when no pair can be merged: n log n for a word of n bytes, also
for a run of 300,000 equal signs. Short words, nearly all, are merged many at once: each level of their trees is an array.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Sequence
from itertools import chain

import numpy as np
import regex

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII alone, which a plainer and faster pattern cuts.
_BLANK = r" \t\n\r\x0b\x0c"
ASCII_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_BLANK}A-Za-z0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
WORDS_KEPT, CHARACTERS_KEPT = 300_000, 8_000_000  # words whose ids a worker remembers, and characters in them; when more, it begins anew
_OTHER = re.compile(r"[^\x00-\x7f]+").search
_NONE = np.iinfo(np.int64).max
_BATCHED = (8, 16, 32, 64)


class Encoder:
    """ids of texts under one vocabulary; remembers words, which doesn't change results."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.width = max(self.bytes_of) + 1
        self.symbols = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            self.ranks[t[:i]] * self.width + self.ranks[t[i:]]: v for t, v in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.any_words = regex.compile(pattern).findall
        self.ascii_words = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else None
        self.known: dict[str, list[int]] = {}
        self.characters = 0  # in the known words
        self.begun = 0  # how often the words were forgotten

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks (ids) of pairs; _NONE where there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge_word(self, word: bytes) -> list[int]:
        """The ids of one word, by its own tree."""
        n = len(word)
        ids = [int(self.symbols[b]) for b in word]
        if n < 2:
            return ids
        p, shift, width, pairs = 1 << (n - 2).bit_length(), n.bit_length(), self.width, self.pairs
        none = 1 << 62
        tree = [none] * (2 * p)
        for i in range(n - 1):
            rank = pairs.get(ids[i] * width + ids[i + 1])
            if rank is not None:
                tree[p + i] = rank << shift | i
        for i in range(p - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def put(leaf: int, value: int) -> None:
            i = p + leaf
            tree[i] = value
            i >>= 1
            while i:
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        while tree[1] != none:
            rank, i = tree[1] >> shift, tree[1] & ((1 << shift) - 1)
            j = after[i]
            k = after[i] = after[j]
            ids[i], alive[j] = rank, False
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
                right = pairs.get(rank * width + ids[k])
                put(i, none if right is None else right << shift | i)
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                left = pairs.get(ids[h] * width + rank)
                put(h, none if left is None else left << shift | h)
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def merge_words(self, words: Sequence[bytes], p: int) -> list[list[int]]:
        """The ids of many words of 2 to p + 1 bytes, their trees side by side."""
        n_words, n = len(words), p + 1
        shift = n.bit_length()
        length = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), dtype=np.uint8).reshape(n_words, n)
        ids = self.symbols[flat]
        at = np.arange(n)
        alive = at < length[:, None]
        after, before = np.tile(at + 1, (n_words, 1)), np.tile(at - 1, (n_words, 1))
        tree = np.full((n_words, 2 * p), _NONE)
        ranks = self._look_up(ids[:, :-1], ids[:, 1:])
        tree[:, p:] = np.where((ranks != _NONE) & alive[:, 1:], (ranks << shift) | at[:-1], _NONE)
        level = p
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        mask = (1 << shift) - 1
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            rank, i = root >> shift, root & mask
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], after[rows, i], alive[rows, j] = rank, k, False
            end = k >= length[rows]
            kk = np.where(end, 0, k)
            before[rows[~end], k[~end]] = i[~end]
            right = np.where(end, _NONE, self._look_up(rank, ids[rows, kk]))
            h = before[rows, i]
            first = h < 0
            hh = np.where(first, 0, h)
            left = np.where(first, _NONE, self._look_up(ids[rows, hh], rank))
            inner = j < p
            tree[rows[inner], p + j[inner]] = _NONE
            tree[rows, p + i] = np.where(right == _NONE, _NONE, (right << shift) | i)
            has = ~first
            tree[rows[has], p + h[has]] = np.where(left[has] == _NONE, _NONE, (left[has] << shift) | h[has])
            nodes = [p + i, p + np.minimum(j, p - 1), p + np.where(first, i, h)]
            for _ in range(p.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] != _NONE]
        flat_ids, counts = ids[alive].tolist(), alive.sum(axis=1).tolist()
        out, start = [], 0
        for c in counts:
            out.append(flat_ids[start : start + c])
            start += c
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Remember the ids of words that aren't known yet."""
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)  # a token's own bytes merge to the token
            if whole is not None:
                self.known[w] = [whole]
            else:
                sized.setdefault(next((p for p in _BATCHED if len(raw) <= p + 1), 0), []).append((w, raw))
        for p, some in sized.items():
            if p and len(some) > 16:
                for at in range(0, len(some), 4096):
                    part = some[at : at + 4096]
                    self.known.update(zip((w for w, _ in part), self.merge_words([r for _, r in part], p), strict=True))
            else:
                self.known.update((w, self.merge_word(r)) for w, r in some)

    def words_of(self, text: str) -> list[str]:
        """A text's words. Stretches of ASCII lines go by the faster pattern: a line end behind anything but a blank always ends a word."""
        if self.ascii_words is None:
            return self.any_words(text)
        if text.isascii():
            return self.ascii_words(text)
        out: list[str] = []
        at, n = 0, len(text)
        while at < n:
            other = _OTHER(text, at)
            if other is None:
                out += self.ascii_words(text, at)
                break
            begin = text.rfind("\n", at, other.start())
            while begin > at and text[begin - 1].isspace():
                begin = text.rfind("\n", at, begin)
            if begin > at:
                out += self.ascii_words(text, at, begin)
            else:
                begin = at
            end = text.find("\n", other.end())
            while end >= 0 and text[end - 1].isspace():
                end = text.find("\n", end + 1)
            at = end if end >= 0 else n
            out += self.any_words(text, begin, at)
        return out

    def words(self, texts: Sequence[str | None]) -> list[list[str]]:
        """The words of texts, all of them known afterwards; none for a null or empty text."""
        found = [self.words_of(t) if t else [] for t in texts]
        new = set(chain.from_iterable(found)).difference(self.known)
        size = sum(map(len, new))
        if self.known and (len(self.known) + len(new) > WORDS_KEPT or self.characters + size > CHARACTERS_KEPT):
            self.known.clear()
            self.characters, self.begun = 0, self.begun + 1
            new = set(chain.from_iterable(found))
            size = sum(map(len, new))
        self.characters += size
        self.learn(new)
        return found

    def encode(self, text: str | None) -> list[int]:
        known = self.known
        return list(chain.from_iterable([known[w] for w in self.words([text])[0]]))

    def count(self, text: str | None) -> int:
        known = self.known
        return sum(map(len, map(known.__getitem__, self.words([text])[0])))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """This process's encoder of a vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]
