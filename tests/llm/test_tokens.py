"""Encoding, decoding, counts and packing against the library."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gritline.llm import bpe, packing, token_counts
from gritline.llm.pretokens import cut_long
from tests.llm.conftest import document_rows

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encode_and_decode(documents, awkward, path):
    rows = [*document_rows([*awkward, None]), (None, "it's", "en", "s", 4), (3, awkward[3], "en", "s", 0)]
    texts = {k: t or "" for k, t, *_ in rows}
    tool = Tokenizer.from_file(path)
    want = dict(zip(texts, library(path, list(texts.values()))))
    got = bpe.decode(bpe.encode(documents(rows, extra=True), path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r["ids"]) == want[r["doc_id"]]
        assert r["decoded"] == tool.decode(want[r["doc_id"]], skip_special_tokens=False)


def test_counts(documents, awkward):
    rows = document_rows([*awkward, None])
    want = [len(x) for x in library(WORDS, [t or "" for _, t, *_ in rows])]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(rows, extra=True), WORDS).collect()}
    assert [got[k]["n_tokens"] for k in range(len(rows))] == want
    assert [got[k]["n_bytes"] for k in range(len(rows))] == [len((t or "").encode()) for _, t, *_ in rows]


def test_whole_tokens_are_proved():
    whole = token_counts.prove_whole(WORDS)
    tool = Tokenizer.from_file(WORDS)
    assert b"the" in whole and 30_000 < len(whole) < 49_408
    plain = [w.decode() for w in sorted(whole)[::97] if w.isascii() and w.islower()]
    assert plain and all(len(tool.encode(w, add_special_tokens=False).ids) == 1 for w in plain)


def test_long_texts_are_cut_between_letters():
    text = "ab cd  ef. gh " * 100
    parts = cut_long(text, 50)
    assert len(parts) > 10 and "".join(parts) == text and all(p[0] == " " and p[1].isalpha() for p in parts[1:])


def pieces_of(ids, tokens):
    head = len(ids) % tokens or tokens
    cuts = [0, *range(head, len(ids) + 1, tokens)]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def test_packing(documents, awkward):
    rows = document_rows([*awkward, None])
    ids = [[*x, 0] for x in library(BYTES, [t or "" for _, t, *_ in rows])]
    want = {(k, n): p for k, x in enumerate(ids) for n, p in enumerate(pieces_of(x, 64))}
    got = packing.pack_documents(documents(rows, extra=True), BYTES, 64).collect()
    assert len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        piece = want[r["doc_id"], r["piece"]]
        assert r["length"] == len(piece)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 64
    least = -(-sum(map(len, want.values())) // 64)
    assert len(bins) <= least * 1.01 + len(got) / packing.BLOCK_ROWS + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.random.default_rng(2).integers(1, 60, 300).astype(float)
    demand = np.stack([lengths, np.ones(300), lengths**2], axis=1)
    capacity = np.array([100.0, 4.0, 4000.0])
    bins, place = packing.best_fit(demand, capacity, np.array([1.0, 0.5, 0.5]), rule)
    used = np.stack([np.bincount(bins, demand[:, k]) for k in range(3)], axis=1)
    assert (used <= capacity).all() and (used.sum(axis=0) == demand.sum(axis=0)).all()
    assert place.min() == 0


def test_packing_with_documents_limit(spark):
    rows = spark.createDataFrame([(k, 5) for k in range(20)], "doc_id long, length long")
    packed = packing.pack(rows, 100, documents=4, attention=75).groupBy("sequence_id").count().collect()
    assert [r["count"] for r in packed] == [3] * 6 + [2] or sorted(r["count"] for r in packed) == [2, 3, 3, 3, 3, 3, 3]


def test_all_three_resources_weigh(spark):
    """Leaving out a weight gives another packing, in as many sequences."""
    lengths = np.random.default_rng(1).integers(1, 2048, 2000).astype(float)
    demand = np.stack([lengths, np.ones(2000), lengths**2], axis=1)
    capacity = np.array([2048.0, 2048.0, 2048.0**2])
    packings = []
    for weights in (packing.WEIGHTS, (1, 0.2, 0), (1, 0, 0.2), (1, 0, 0)):
        bins, _ = packing.best_fit(demand, capacity, np.array(weights, float), "norm")
        packings.append(frozenset(frozenset(np.flatnonzero(bins == b).tolist()) for b in range(bins.max() + 1)))
    assert len(set(packings)) == 4 and all(w > 0 for w in packing.WEIGHTS)
    assert {len(p) for p in packings} == {len(packings[0])}


def test_packing_keeps_columns_and_spreads_equal_rows(spark):
    rows = spark.createDataFrame([(5, "x", 1)] * 1000, "length long, block string, _block int")
    got = packing.pack(rows, 50, block_rows=100).collect()
    assert {(r["block"], r["_block"]) for r in got} == {("x", 1)} and len(got) == 1000
    blocks = {r["sequence_id"] >> 32 for r in got}
    assert len(blocks) == 10
    for taken in ("offset", "SEQUENCE_ID"):
        with pytest.raises(ValueError):
            packing.pack(rows.withColumnRenamed("block", taken), 50)


@pytest.mark.parametrize("letters", ["ab", "theing", "x", "abcdefghijklmnopqrstuvwxyz"])
def test_very_long_words(documents, letters):
    """Words of 200,000 letters end within seconds, in each of the three."""
    pick = random.Random(8)
    text = "".join(pick.choice(letters) for _ in range(200_000))
    df = documents(document_rows([text]))
    words, pieces = (library(path, [text])[0] for path in (WORDS, BYTES))
    started = time.perf_counter()
    assert token_counts.count_tokens(df, WORDS).first()["n_tokens"] == len(words)
    assert list(bpe.encode(df, WORDS).first()["ids"]) == words
    got = packing.pack_documents(df, BYTES, 2048).orderBy("piece").collect()
    assert [r["length"] for r in got] == [len(p) for p in pieces_of([*pieces, 0], 2048)]
    assert time.perf_counter() - started < 60


def test_empty_tables(documents):
    none = documents([])
    assert bpe.decode(bpe.encode(none, WORDS), WORDS).count() == 0
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert packing.pack_documents(none, BYTES, 64).count() == 0


def test_digest_of_ids(documents):
    """The digests of the query, on one text."""
    from pyspark.sql import functions as F

    got = bpe.encode(documents(document_rows(["Hello there"])), WORDS)
    row = got.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h")).first()
    ids = library(WORDS, ["Hello there"])[0]
    assert row["h"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
