"""Files of token ids: codes are the best ones, and what is read back is what the library gives."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gritline.llm import huffman
from gritline.operators.skew import shared_dir
from tests.llm.conftest import document_rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    """(doc_id, start, ids) in the order of the files."""
    tool = Tokenizer.from_file(BYTES)
    ids = [[*tool.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows]

    def key(pair):
        (doc, *_), x = pair
        return doc is not None, doc or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())

    out, start = [], 0
    for (doc, *_), x in sorted(zip(rows, ids), key=key):
        out.append((doc, start, x))
        start += len(x)
    return out


def read(spark, folder):
    got = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in huffman.read_ids(spark, folder).collect()]
    return sorted(got, key=lambda r: r[1])


@pytest.mark.parametrize("block_ids", [100, huffman.BLOCK_IDS])
def test_round_trip(spark, documents, awkward, block_ids):
    rows = [*document_rows([*awkward, None]), (None, "it's", "en", "s", 4), (3, awkward[3], "en", "s", 0), (3, "x", "en", "s", 1)]
    rows = rows[::-1]
    folder = shared_dir(spark)
    huffman.write_ids(documents(rows, extra=True), BYTES, folder, block_ids=block_ids)
    want = plain(rows)
    assert read(spark, folder) == want
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("part", "first").collect()
    assert [d for b in blocks for d in b["doc_ids"]] == [d for d, _, _ in want]
    assert all(b["n_ids"] - b["sizes"][-1] < block_ids for b in blocks)
    codes = spark.read.parquet(f"{folder}/codes").collect()
    assert {c["id"] for c in codes} == {i for *_, ids in want for i in ids}
    assert sum(2.0 ** -c["bits"] for c in codes) <= 1 and max(c["bits"] for c in codes) <= huffman.LONGEST_CODE


def test_equal_rows_and_one_symbol(spark, documents):
    folder = shared_dir(spark)
    huffman.write_ids(documents([(1, "", "en", "s", 0)] * 500), BYTES, folder, block_ids=64)
    assert read(spark, folder) == [(1, k, [2]) for k in range(500)]


def test_empty_table(spark, documents):
    folder = shared_dir(spark)
    huffman.write_ids(documents([]), BYTES, folder)
    assert huffman.read_ids(spark, folder).collect() == []


def test_blocks_decode_alone(spark, documents, awkward):
    """A reader that asks for some blocks gets their documents with the same starts."""
    rows = document_rows(awkward[:200])
    folder, part = shared_dir(spark), shared_dir(spark)
    huffman.write_ids(documents(rows), BYTES, folder, block_ids=100)
    spark.read.parquet(f"{folder}/codes").write.parquet(f"{part}/codes")
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.where("part = 0 AND first > 0").write.parquet(f"{part}/blocks")
    got = read(spark, part)
    assert got and set(map(str, got)) <= set(map(str, plain(rows)))


def test_lengths_are_the_best_within_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = rng.integers(1, 100, 5) ** 3
        some = itertools.product(range(1, 4), repeat=5)
        best = min(sum(n * c for n, c in zip(ls, counts)) for ls in some if sum(2.0**-n for n in ls) <= 1)
        lengths = huffman.code_lengths(counts, 3)
        assert (lengths * counts).sum() == best and lengths.max() <= 3
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    assert huffman.code_lengths(np.array(fibonacci), 18).max() == 18
    assert huffman.code_lengths(np.array([7])).tolist() == [1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_codes_are_canonical_and_end_anywhere():
    ids, lengths = np.array([9, 4, 7, 0]), np.array([2, 1, 3, 3])
    book = huffman.Book(ids, lengths)
    assert [int(book.code[k]) for k in (4, 9, 0, 7)] == [0, 0b10, 0b110, 0b111]
    for n in (0, 1, 31, 255, 256, 257, 1000):
        text = ids[np.random.default_rng(n).integers(0, 4, n)]
        bits, starts = book.encode(text)
        runs = np.full(len(starts), huffman.CHECKPOINT)
        runs[-1:] = n - huffman.CHECKPOINT * (len(starts) - 1)
        words = np.append(np.frombuffer(bits, ">u4"), 0)
        assert book.decode(words, starts, runs).tolist() == text.tolist()
