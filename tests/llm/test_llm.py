"""Encoding, mixing and splitting against brute force and a public library."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, mixing
from tidewatch.llm.encode import token_counts, token_ids
from tidewatch.llm.mixing import choose, shares
from tidewatch.llm.splitting import pieces, split_text

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def theirs():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", "a", "hello world", "  two  blanks\n\n\tand tabs \r\n", "<|endoftext|>", "naïve café — “quotes” 日本語テキスト русский 😀👩‍👩‍👧", "=" * 5000, "-" * 318_000, "a" * 3001, "\n" * 1000 + "x", "x'll 'tis we've I'd",
    "ZWJ‍​﻿\x00\x7f", "९९ ①②③ Ⅷ", "base64: iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk",
]


def test_same_ids(theirs):
    e = bpe.Encoder()
    rnd = random.Random(1)
    more = ["a\x1cb \x1d\x1e \x85 \xa0x\u2028\n\u3000", "a\n é\nb \nc\n\nd\r\n…e\nf"]
    more += ["".join(rnd.choice(["ab ", "\n", "x9", " ", "\r\n", "é", "…\n", "\x1f", "'s", "_-"]) for _ in range(rnd.randint(1, 120))) for _ in range(600)]
    more += ["".join(rnd.choice("ab =-_zé\n0") for _ in range(rnd.randint(1, 150))) for _ in range(400)]
    for t in TEXTS + more:
        assert e.encode(t) == theirs.encode_ordinary(t)
    assert e.encode(None) == []


def test_every_token_is_its_own_merge():
    e = bpe.Encoder()
    sized = {}
    for raw, rank in e.ranks.items():
        if len(raw) > 1:
            sized.setdefault(next((p for p in bpe._BATCHED if len(raw) <= p + 1), 0), []).append((raw, rank))
    for p, some in sized.items():
        got = e.merge_words([r for r, _ in some], p) if p else [e.merge_word(r) for r, _ in some]
        assert got == [[rank] for _, rank in some]
    short = [(r, k) for r, k in sized[8][:500]]
    assert [e.merge_word(r) for r, _ in short] == [[k] for _, k in short]


def test_forgetting_changes_nothing(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    e = bpe.Encoder()
    assert [e.encode(t) for t in TEXTS[:6]] == [theirs.encode_ordinary(t) for t in TEXTS[:6]]


def test_token_ids(spark, theirs):
    df = spark.createDataFrame([*enumerate(TEXTS), (98, None), (98, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = token_ids(df, "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.ids == ([] if r.doc_id == 98 else theirs.encode_ordinary(TEXTS[r.doc_id]))
    assert {r.doc_id: r.n_tokens for r in token_counts(df, "text", ["doc_id"]).collect()} == {r.doc_id: len(r.ids) for r in got}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0


def _brute_mix(sizes, weights, repeats, budget, order):
    items = []
    for s, w in weights.items():
        docs, total = order[s], sum(sizes[d] for d in order[s])
        for r in range(repeats):
            upto = 0
            for d in docs:
                upto += sizes[d]
                items.append(((r * total + upto) / w, s, d, r))
    got, used = [], 0
    for _, s, d, r in sorted(items):
        if used + sizes[d] > budget:
            break
        used += sizes[d]
        got.append((s, d, r))
    return got


def test_mixing_equals_the_queue(spark):
    rnd = random.Random(4)
    docs = [(i, "Big One" if i % 3 == 0 else rnd.choice(["big-one", "rare"]) if i % 10 == 1 else rnd.choice(["mid", None, "MID "]), " ".join(["word"] * rnd.randint(0, 60))) for i in range(300)]
    docs += [(900, "mid", None), (901, "mid", "")]
    targets = [("m", "big_one", 5.0, 2, 0.5), ("m", "rare", 4.0, 2, 0.5), ("m", "mid", 1.0, 2, 0.5), ("m", "absent", 3.0, 2, 0.5), ("m", "zero", 0.0, 2, 0.5), ("m", "none", None, 2, 0.5), ("all", "rare", 1.0, 3, 9.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame(targets, "mix_name string, source string, target_weight double, max_repeats int, size_ratio double")
    chosen, plan = choose(d, t)
    sizes = {r.doc_id: r.n_tokens for r in token_counts(d, "text", ["doc_id"]).collect()}
    named = {i: {"bigone": "bigone", "big_one": "bigone"}.get((s or "").lower().replace(" ", "").replace("-", ""), (s or "").lower().strip()) for i, s, _ in docs}
    ranked = sorted(sizes, key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())
    order = {s: [i for i in ranked if named[i] == s and sizes[i] > 0] for s in ("bigone", "rare", "mid")}
    want = _brute_mix(sizes, {"bigone": 5.0, "rare": 4.0, "mid": 1.0}, 2, int(0.5 * sum(sizes.values())), order)
    got = sorted((r.source, r.doc_id, r["round"]) for r in chosen.where("mix = 'm'").collect())
    assert got == sorted(want)
    assert chosen.where("mix = 'all'").count() == 3 * len(order["rare"])
    found = {(r.mix, r.source): r for r in shares(chosen, plan).collect()}
    assert found["m", "absent"].chosen_docs == 0 and found["m", "absent"].target_share == pytest.approx(3 / 13)
    assert found["all", "rare"].most_times == 3 and found["all", "rare"].actual_share == 1.0
    none, _ = choose(d.limit(0), t)
    assert none.count() == 0


def test_rounds_reach_the_budget(spark):
    docs = spark.createDataFrame([(i, s, " a" * n) for i, (s, n) in enumerate([("A", 10_000), ("B", 10_000), ("C", 10_000), ("D", 10)])], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", s, 0.25, 1_000, 100.5 / 30_010) for s in "ABCD"], "mix_name string, source string, target_weight double, max_repeats int, size_ratio double")
    chosen, _ = choose(docs, targets)
    assert [(r.source, r["count"]) for r in chosen.groupBy("source").count().collect()] == [("d", 10)]


def test_mixes_without_a_budget(spark):
    """A mix of ratio 0, null, NaN or below 0 has no documents and its rows in the shares; the others are as they were."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "word " * 9) for i in range(40)], "doc_id bigint, source string, text string")
    ratios = {"none": None, "nan": float("nan"), "zero": 0.0, "less": -1.0, "some": 0.5}
    targets = spark.createDataFrame([(m, s, 1.0, 2, x) for m, x in ratios.items() for s in "ab"], "mix_name string, source string, target_weight double, max_repeats int, size_ratio double")
    chosen, plan = choose(docs, targets)
    assert {r.mix for r in chosen.collect()} == {"some"} and chosen.count() == 20
    found = shares(chosen, plan).collect()
    assert len(found) == 10 and {(r.actual_share, r.chosen_docs, r.target_share) for r in found if r.mix != "some"} == {(0.0, 0, 0.5)}


def test_mixing_of_given_sizes_in_narrow_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOKENS_A_RANGE", 3)
    monkeypatch.setattr(mixing, "LEAST_RANGES", 2)
    rnd = random.Random(6)
    data = [(i, rnd.choice("aaab"), rnd.choice([0, 1, 2, 50, None])) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id bigint, source string, size int")
    t = spark.createDataFrame([("m", "a", 2.0, 3, 0.8), ("m", "b", 5.0, 3, 0.8)], "mix_name string, source string, target_weight double, max_repeats int, size_ratio double")
    chosen, _ = choose(d, t, size=F.col("size"))
    sizes = {i: n or 0 for i, _, n in data}
    ranked = sorted(sizes, key=lambda i: hashlib.md5(f"{i}:7".encode()).hexdigest())
    order = {s: [i for i in ranked if data[i][1] == s and sizes[i]] for s in "ab"}
    want = _brute_mix(sizes, {"a": 2.0, "b": 5.0}, 3, int(0.8 * sum(sizes.values())), order)
    assert sorted((r.source, r.doc_id, r["round"]) for r in chosen.collect()) == sorted(want)


def test_words_are_kept_by_size(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CHARACTERS_KEPT", 1_000)
    e = bpe.Encoder()
    for n in range(60):
        text = chr(97 + n % 26) * (300 + n)
        assert e.encode(text) == theirs.encode_ordinary(text)
        assert sum(map(len, e.known)) == e.characters <= 1_000


def test_splitting(theirs):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma\n", "delta.", "é日本", "\n\n", "  ", "0123456789"]
    for text in [" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 900, 5000)] + ["=" * 60_000, "日本語" * 3000, "x" * 20_000, "\n" * 30_000]:
        cells = sorted(rnd.sample(range(len(text)), 9)) + [-4, len(text) + 5, None]
        got = split_text(text, cells, 512, 32)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        whole = len(theirs.encode_ordinary(text))
        assert (len(got) > 1) == (whole > 512)
        for a, b, n in got:
            assert len(theirs.encode_ordinary(text[a:b])) == n <= 512
        for p, q in zip(got, got[1:]):
            assert p[0] < q[0] < p[1] < q[1]
            assert len(theirs.encode_ordinary(text[q[0] : p[1]])) >= 32
    assert split_text(None) == [(0, 0, 0)] and split_text("") == [(0, 0, 0)]


def test_overlap_of_blanks(theirs):
    """Blanks at a cut join to fewer tokens by themselves; the overlap grows until it has its tokens."""
    text = ("word" + " " * 40 + "\n") * 400
    got = split_text(text, None, 256, 64)
    assert len(got) > 2
    for p, q in zip(got, got[1:]):
        assert len(theirs.encode_ordinary(text[q[0] : p[1]])) >= 64


def test_cells_are_preferred():
    cell = "one two three four five six seven eight nine ten\n" * 5
    text = cell * 20
    starts = list(range(0, len(text), len(cell)))
    got = split_text(text, starts, 256, 16)
    assert len(got) > 2 and all(b in starts for _, b, _ in got[:-1])


def test_pieces(spark):
    long = "line of words\n" * 2000
    df = spark.createDataFrame([(1, long, [0, 1400]), (2, "short", None), (3, None, []), (4, "", [0])], "doc_id bigint, text string, cell_starts array<int>").withColumn("piece", F.lit("clash"))
    got = pieces(df, "doc_id", "text", "cell_starts").collect()
    assert {r.doc_id for r in got if r.n_pieces > 1} == {1}
    assert all(r.piece == long[r.start_char : r.end_char] for r in got if r.doc_id == 1)
    light = pieces(df, "doc_id", "text", "cell_starts", with_text=False).collect()
    assert sorted((r.doc_id, r.piece_no, r.end_char, r.n_tokens) for r in light) == sorted((r.doc_id, r.piece_no, r.end_char, r.n_tokens) for r in got)
    assert pieces(df.limit(0), "doc_id", "text", None).count() == 0


def test_keys_of_the_results_names(spark):
    df = spark.createDataFrame([(1, "a")], "ids int, text string")
    with pytest.raises(ValueError):
        token_ids(df, "ids", "text")
    with pytest.raises(ValueError):
        pieces(df.withColumnRenamed("ids", "piece"), "piece", "text", None)


def test_repeated_documents(spark):
    """Rows with one doc_id are documents of their own, in any operator."""
    df = spark.createDataFrame([(1, "s", "a b c", None)] * 3 + [(None, "s", "d", [0, 2])], "doc_id bigint, source string, text string, cell_starts array<int>")
    assert token_ids(df, "doc_id", "text").count() == 4 == pieces(df, "doc_id", "text", "cell_starts").count()
    targets = spark.createDataFrame([("m", "s", 1.0, 1, 1.0)] * 2, "mix_name string, source string, target_weight double, max_repeats int, size_ratio double")
    chosen, plan = choose(df, targets)
    assert chosen.count() == 4 and shares(chosen, plan).first().actual_share == 1.0
