"""Packing: ids against the library, placements against the rules, bins against the lower bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoscope.llm import frames, packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encode():
    with open(FILE, encoding="utf-8") as f:
        return packing.encoder(f.read())


PART = st.sampled_from([" ", "  ", "\n", "\n\n \t", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'LL", "word", "Ünï", "漢字", "12", "²", "_", "...", "<|endoftext|>", "<|",
                        "\x00", "😀", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PART, st.text(max_size=5)), max_size=14))
def test_ids_of_the_library(encode, parts):
    text = "".join(parts)
    assert encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs(encode):
    for text in (" " * 5000 + "x", "\n" * 3000, "z" * 20_000, "ab" * 9000, " \n" * 2000 + "é"):
        assert encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_bins(lengths):
    bins = packing.pack_shard(lengths, [-1] * len(lengths), 40)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 40))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 39), min_size=2, max_size=40))
def test_every_exchange_raises_squared_fill(lengths):
    bins = [[i] for i in range(len(lengths))]
    search = packing.Search(bins, lengths, 40)
    for donor in range(len(bins)):
        search.donor = donor
        before = sum(f * f for f in search.fill)
        while search.bins[donor] and search.step():
            now = sum(f * f for f in search.fill)
            assert now > before and search.fill == [sum(lengths[i] for i in b) for b in search.bins] and max(search.fill) <= 40
            before = now
        search.donor = -1
        search.enter(donor)


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(3)
    lengths = [rng.randint(650, 720) for _ in range(1500)]
    assert len(packing.pack_shard(lengths, [-1] * 1500, 2048)) < 0.95 * len(packing.best_fit(lengths, 2048))


def check(rows, texts, capacity):
    """Pieces of ``texts`` (number, text), each placed once, sequences gapless; returns the number of sequences."""
    want = []
    for number, text in texts:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids), capacity)]
        want += [(number, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    return len(filled)


def test_table(spark, docs, nothing):
    """Nulls, repeated rows, texts longer than a sequence, clashing names; several shards and rounds."""
    table = docs.withColumns({c: F.lit("x") for c in ("length", "sequence_id", "__bin")})
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    total = sum(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    for capacity, shard in ((2048, 8192), (64, 5), (300, 4)):
        rows = packing.pack(table, FILE, capacity=capacity, shard=shard).collect()
        assert check(rows, texts, capacity) <= 1.02 * total / capacity + 3
    assert packing.pack(nothing, FILE).collect() == []
    assert packing.pack(docs.where("text = ''"), FILE).count() == docs.where("text = ''").count()


def test_hot_lengths(spark):
    """A third of all pieces has one length, a third is copies of one text: shards stay bounded, all rows are placed."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit("one same text")).when(F.col("id") % 3 == 1, F.lit("a b c"))
                                    .otherwise(F.repeat(F.lit(" x"), (F.col("id") % 50 + 1).cast("int"))).alias("text"))
    rows = packing.pack(docs, FILE, capacity=100, shard=200).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    total = sum(len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    assert check(rows, texts, 100) <= -(-total // 100) + 2


def test_sequences_hold_the_tokens(spark, docs):
    packed = frames.stored(packing.pack(docs, FILE, capacity=256, with_ids=True))
    by = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 256
        for s in r.spans:
            assert r.ids[s.offset:s.offset + s.length] == by[r.sequence_id, s.offset].ids
    with pytest.raises(ValueError):
        packing.place(packed, capacity=10)
