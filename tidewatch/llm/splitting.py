"""Cutting texts above a token limit into overlapping pieces at natural boundaries.

Balanced targets: the fewest pieces that can hold the text with its overlaps, of equal length; each target is moved to the
strongest boundary near it (between cells, paragraphs, lines, then sentences and words), the nearest of equal strength. Pieces
are then encoded as they are; if one is over the limit, a piece is added and the targets are set anew.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.llm.bpe import VOCABULARY, Encoder, encoder
from tidewatch.llm.encode import uncollected

TEXTS_AT_ONCE = 128

LIMIT, OVERLAP = 2_048, 128
NEAR = 0.25  # of a piece's length: how far from its target a boundary may lie
CELL, PARAGRAPH, LINE, SENTENCE, WORD, ANY = 5, 4, 3, 2, 1, 0
_NATURAL = ((PARAGRAPH, re.compile(r"(?:\r?\n[ \t]*){2,}")), (LINE, re.compile(r"\r?\n")), (SENTENCE, re.compile(r"[.!?。！？]+[\"')\]]*\s+|[。！？]")))


class _Measured:
    """A text's words with running sums of characters and tokens."""

    def __init__(self, text: str, e: Encoder, words: list[str]):
        self.text = text
        self.tokens = [e.known[w] for w in words]
        self.chars = np.fromiter(accumulate(map(len, words), initial=0), dtype=np.int64, count=len(words) + 1)
        self.upto = np.fromiter(accumulate(map(len, self.tokens), initial=0), dtype=np.int64, count=len(words) + 1)
        self.total = int(self.upto[-1])
        self.e, self.within = e, {}

    def inside(self, k: int) -> list[tuple[int, int]]:
        """(character, token) boundaries inside word k where a token begins with a whole character."""
        if k not in self.within:
            out, decoder, at = [], codecs.getincrementaldecoder("utf-8")(), int(self.chars[k])
            for n, t in enumerate(self.tokens[k][:-1], 1):
                at += len(decoder.decode(self.e.bytes_of[t]))
                if not decoder.getstate()[0]:
                    out.append((at, int(self.upto[k]) + n))
            self.within[k] = out
        return self.within[k]

    def token_at(self, char: int) -> int:
        """Tokens up to a character, that which it cuts included."""
        k = int(np.searchsorted(self.chars, char, side="left"))
        if self.chars[k] == char:
            return int(self.upto[k])
        return next((t for c, t in self.inside(k - 1) if c >= char), int(self.upto[k]))

    def back(self, char: int, tokens: int) -> int:
        """The last character position at least so many tokens before char, on a token that begins with a whole character."""
        want = self.token_at(char) - tokens
        if want <= 0:
            return 0
        k = int(np.searchsorted(self.upto, want, side="right")) - 1
        if self.upto[k] == want:
            return int(self.chars[k])
        fits = [c for c, t in self.inside(k) if t <= want]
        return fits[-1] if fits else int(self.chars[k])

    def overlapping(self, cut: int, tokens: int) -> int:
        """Where the piece after cut begins: the overlap, encoded by itself, has the tokens (blanks at its end may join to fewer),
        or is all of the text before the cut."""
        more = 0
        while True:
            start = self.back(cut, tokens + more)
            short = tokens - self.e.count(self.text[start:cut])
            if start == 0 or short <= 0:
                return start
            more += short


def _boundaries(m: _Measured, cells: Sequence[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (characters, tokens) where the text may be cut and their strengths; a position has its greatest."""
    found: dict[int, int] = dict.fromkeys(m.chars[1:-1].tolist(), WORD)
    for strength, pattern in reversed(_NATURAL):
        found.update(dict.fromkeys((x.end() for x in pattern.finditer(m.text)), strength))
    found.update(dict.fromkeys((c for c in cells or () if c is not None and 0 < c < len(m.text)), CELL))
    for k in np.flatnonzero(np.diff(m.upto) > 16).tolist():
        for c, _ in m.inside(k):
            found.setdefault(c, ANY)
    found.pop(len(m.text), None)
    at = np.array(sorted(found), dtype=np.int64)
    tokens = m.upto[np.searchsorted(m.chars, at, side="left")]
    for k in np.flatnonzero(np.diff(m.upto) > 16).tolist():
        inner = m.inside(k)
        chars, upto = np.array([c for c, _ in inner] + [m.chars[k + 1]]), np.array([t for _, t in inner] + [m.upto[k + 1]])
        low, high = np.searchsorted(at, [m.chars[k] + 1, m.chars[k + 1]])
        tokens[low:high] = upto[np.searchsorted(chars, at[low:high], side="left")]
    return at, tokens, np.array([found[c] for c in at.tolist()], dtype=np.int64)


def _cuts(m: _Measured, n: int, limit: int, overlap: int, at: np.ndarray, tokens: np.ndarray, strength: np.ndarray) -> list[int] | None:
    """The characters after which n pieces end; None if some target has no boundary that keeps within the limit."""
    length = (m.total + (n - 1) * overlap) / n
    cuts, last, last_token = [], 0, 0
    for k in range(1, n):
        target = length + (k - 1) * (length - overlap)
        most = last_token - (overlap + 1 if k > 1 else 0) + limit
        least = m.total - (n - k) * (limit - overlap)
        low = np.searchsorted(tokens, max(target - NEAR * length, least, last_token + 1), side="left")
        high = np.searchsorted(tokens, min(target + NEAR * length, most), side="right")
        low = max(low, int(np.searchsorted(at, last, side="right")))
        if low >= high:  # nothing near: any boundary within the limit
            low = max(int(np.searchsorted(tokens, last_token + 1, side="left")), int(np.searchsorted(at, last, side="right")))
            high = int(np.searchsorted(tokens, most, side="right"))
            if low >= high:
                return None
        near = np.abs(tokens[low:high] - target)
        best = low + int(np.lexsort((near, -strength[low:high]))[0])
        last, last_token = int(at[best]), int(tokens[best])
        cuts.append(last)
    return cuts


def split_text(text: str | None, cells: Sequence[int] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, e: Encoder | None = None, words: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, in characters. A text of at most limit tokens is one piece, so are null and empty ones
    (0, 0, 0). Each further piece begins `overlap` tokens of the text before the cut (more where a character spans tokens)."""
    if not text:
        return [(0, 0, 0)]
    e = e or encoder()
    words = e.words([text])[0] if words is None else words
    total = sum(map(len, map(e.known.__getitem__, words)))
    if total <= limit:
        return [(0, len(text), total)]
    m = _Measured(text, e, words)
    at, tokens, strength = _boundaries(m, cells)
    n = max(2, -(-(m.total - overlap) // (limit - overlap)))
    counted: dict[tuple[int, int], int] = {}  # pieces that came up with fewer pieces too aren't encoded again
    begins: dict[int, int] = {}
    while n <= len(at) + 1:
        cuts = _cuts(m, n, limit, overlap, at, tokens, strength)
        if cuts is not None:
            begins.update((c, m.overlapping(c, overlap)) for c in cuts if c not in begins)
            spans = list(zip([0, *(begins[c] for c in cuts)], [*cuts, len(text)], strict=True))
            counted.update((x, e.count(text[x[0] : x[1]])) for x in spans if x not in counted)
            if all(counted[x] <= limit for x in spans):
                return [(*x, counted[x]) for x in spans]
        n += 1
    raise ValueError("the limit can't be kept: a single character has more tokens")


def pieces(df: DataFrame, key: str, text: str, cells: str | None, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece_no from 0, n_pieces, start_char, end_char, n_tokens, piece): the ordered pieces of every row's text.

    Every text is encoded whole, each where it lies; nothing is shuffled. Null and empty texts are one empty piece. Positions
    in `cells` outside of the text are ignored. with_text=False leaves piece null. Rows with the same key are split each on its
    own. ValueError for a key of the result's names.
    """
    names = [key, "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "piece"]
    if len(set(names)) < len(names):
        raise ValueError("the key needs a name other than the result's columns")

    def cut(e: Encoder, some: pd.DataFrame, out: list[tuple]) -> None:
        bodies = [x if isinstance(x, str) else None for x in some[text]]
        words = e.words(bodies)  # learnt together
        marks = some[cells] if cells else [None] * len(some)
        anew = e.begun
        for name, body, found_words, starts in zip(some[key], bodies, words, marks, strict=True):
            # pieces of a text before may have made the encoder begin anew
            known = found_words if e.begun == anew else None
            found = split_text(body, None if starts is None else list(starts), limit, overlap, e, known)
            out.extend((name, k, len(found), a, b, t, body[a:b] if with_text and body is not None else None) for k, (a, b, t) in enumerate(found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for at, batch in ((at, b) for b in batches for at in range(0, len(b), TEXTS_AT_ONCE)):
            out: list[tuple] = []
            some = batch.iloc[at : at + TEXTS_AT_ONCE]
            with uncollected():
                cut(e, some, out)
            yield pd.DataFrame(out, columns=names)

    schema = f"`{key}` {dict(df.dtypes)[key]}, piece_no int, n_pieces int, start_char bigint, end_char bigint, n_tokens bigint, piece string"
    return df.select(key, text, *([cells] if cells else [])).mapInPandas(run, schema)
