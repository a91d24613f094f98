"""Token ids and token counts of every text, in Arrow batches where the texts lie; no shuffle."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.bpe import VOCABULARY, encoder

TEXTS_AT_ONCE = 512


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(at, TEXTS_AT_ONCE)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's cycle collector, which finds nothing among millions of strings and lists of numbers, but looks."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row for each row of df, the ids without special tokens. A null and an empty text have the
    empty list; so has no other text. Whole texts are encoded; strings that look like special tokens are ordinary text.
    Rows with the same key stay rows of their own. ValueError for a key named ids.
    """
    if key == "ids":
        raise ValueError("the key needs a name other than ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in _chunks(batches):
            with uncollected():
                found = e.words(batch.column(1).to_pylist())
                of = e.known.__getitem__
                each = [list(chain.from_iterable(map(of, w))) for w in found]
                ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep with n_tokens, the length of the text's token_ids; 0 for a null or empty text."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in _chunks(batches):
            with uncollected():
                found = e.words(batch.column(batch.num_columns - 1).to_pylist())
                length = {w: len(e.known[w]) for w in set(chain.from_iterable(found))}.__getitem__
                of = e.known.__getitem__
                counts = [sum(map(len, map(of, words))) for words in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens bigint"])
    return df.select(*keep, text).mapInArrow(run, schema)
