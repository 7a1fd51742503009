"""Token ids in files of canonical, length-limited Huffman codes, in blocks that decode on their own.

A folder holds two tables, written by Spark so that a lost task leaves nothing behind:

- ``codes``: ``id`` and ``bits``, the length of its code. Codes are canonical: in order of length, then
  of id, each is the next number, so lengths tell all.
- ``blocks``: whole documents in ascending order, about 65,536 ids to a block. ``part`` and ``first``
  (ids of the part before the block) give the order; ``doc_ids`` and ``sizes`` the documents; ``bits``
  the codes, from the highest bit on; ``checkpoints`` the bit at which every 256th id starts
  (little-endian unsigned 64-bit numbers).
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritline.llm.batches import map_text, offsets_of, sliced
from gritline.llm.packing import byte_encoder
from gritline.llm.vocabulary import load, read
from gritline.operators.skew import stage

LONGEST_CODE = 18
BLOCK_IDS = 1 << 16
CHECKPOINT = 256
_BLOCK = pa.schema([
    ("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("bits", pa.binary()),
])


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of the best prefix codes of at most ``longest`` bits, by merging packages.

    ``counts`` are positive. A code bit of a symbol is a coin of one of ``longest`` values and the
    symbol's count as weight; coins of a value, lightest first, are paired to packages of the next.
    The lightest 2n - 2 of the last value use, of each value, the lightest coins, so it takes only
    how many of them are symbols.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols do not fit into codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.float64)
    made, packages = [], np.zeros(0)
    for _ in range(longest):
        weights = np.concatenate([coins, packages])
        by = np.argsort(weights, kind="stable")
        made.append(np.cumsum(by < n))  # symbols among the lightest ones
        weights = weights[by]
        pairs = len(weights) // 2
        packages = weights[: 2 * pairs].reshape(pairs, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbols in reversed(made):
        if not take:
            break
        used = int(symbols[take - 1])
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    return lengths


class Book:
    """Codes of all ids, and a table that finds the id at the head of any bits."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.longest = int(lengths.max(initial=1))
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        room = np.int64(1) << (self.longest - lengths)  # entries of the table that a code heads
        begins = offsets_of(room)[:-1]
        self.code = np.zeros(int(ids.max(initial=0)) + 1, np.uint64)
        self.length = np.zeros(len(self.code), np.int64)
        self.code[ids] = (begins >> (self.longest - lengths)).astype(np.uint64)
        self.length[ids] = lengths
        self.id_at = np.zeros(1 << self.longest, np.uint32)
        self.length_at = np.zeros(1 << self.longest, np.int64)
        used = int(room.sum())
        self.id_at[:used] = np.repeat(ids, room)
        self.length_at[:used] = np.repeat(lengths, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The codes of all ids in a row, in whole 32-bit words, and the bit at which each checkpoint starts."""
        lengths = self.length[ids]
        at = offsets_of(lengths)
        word = at[:-1] >> 5
        inside = at[:-1] & 31
        value = self.code[ids] << (64 - inside - lengths).astype(np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.bitwise_or.reduceat(value, heads) if len(ids) else value
        out = np.zeros((int(at[-1]) + 31 >> 5) + 1, np.uint32)
        out[word[heads]] |= (both >> np.uint64(32)).astype(np.uint32)
        out[word[heads] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out[:-1].astype(">u4").tobytes(), at[:-1][::CHECKPOINT]

    def decode(self, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids that ``counts`` codes from each bit in ``starts`` on stand for, run by run.

        ``words`` are 32-bit words with one more behind the last. All runs go on by one id at a time
        together, so a step is a few array operations.
        """
        order = np.argsort(-counts, kind="stable")
        at, running = starts[order], counts[order]
        out = np.zeros((len(starts), int(counts.max(initial=0))), np.uint32)
        wide = words.astype(np.uint64)
        drop = np.uint64(64 - self.longest)
        for step in range(out.shape[1]):
            live = int(np.searchsorted(-running, -step, "left"))
            here = at[:live]
            word = here >> 5
            window = (wide[word] << np.uint64(32) | wide[word + 1]) << (here & 31).astype(np.uint64) >> drop
            out[:live, step] = self.id_at[window]
            here += self.length_at[window]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        out = out[back]
        return out[np.arange(out.shape[1]) < counts[:, None]]


def text_ids(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``length``, ``crc`` and ``ids`` of every row, with ``end_id`` after each text's ids.

    ``ids`` are little-endian unsigned numbers as wide as the vocabulary needs (see ``_width``), ``crc``
    their checksum as 32-bit numbers.
    """
    packed, width = read(vocabulary), _width(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = byte_encoder(packed).encode(batch.column(1).to_pylist())
        ids = np.insert(ids, ends[1:], end_id).astype("<u4")
        ends = ends + np.arange(len(ends))
        sums = np.array([zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])], np.int64)
        return pa.record_batch(
            [batch.column(0), pa.array(np.diff(ends)), pa.array(sums), _blobs(ids.astype(width), ends)],
            names=["doc_id", "length", "crc", "ids"],
        )

    return map_text(df, work, "doc_id bigint, length bigint, crc bigint, ids binary", id_col, text_col)


def _width(vocabulary: str) -> str:
    """Two bytes hold the ids of most vocabularies."""
    return "<u2" if len(load(read(vocabulary)).strings) <= 1 << 16 else "<u4"


def _blobs(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    edges = pa.py_buffer((ends * ids.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, edges, pa.py_buffer(ids)])


def global_counts(ids: DataFrame, width: str) -> DataFrame:
    """``id`` and ``n`` over all rows; a task sends at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in sliced(batches, text=0):
            some = np.bincount(_ids_of(part.column(0), width)[0], minlength=len(total))
            some[: len(total)] += total
            total = some
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _ids_of(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them in a row, and where each row's begin."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    all_ids, size = np.frombuffer(column.buffers()[2] or b"", width), np.dtype(width).itemsize
    return all_ids[ends[0] // size : ends[-1] // size], (ends - ends[0]) // size


@functools.lru_cache(maxsize=2)
def _book(ids: bytes, lengths: bytes) -> Book:
    return Book(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


def _block(book: Book, part: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in docs])
    bits, checkpoints = book.encode(ids)
    row = {
        "part": part, "first": first, "n_ids": len(ids), "doc_ids": [d for d, _ in docs],
        "sizes": [len(x) for _, x in docs], "checkpoints": checkpoints.astype("<u8").tobytes(), "bits": bits,
    }
    return pa.RecordBatch.from_pylist([row], _BLOCK)


def write_ids(
    df: DataFrame,
    vocabulary: str,
    folder: str,
    end_id: int = 2,
    longest: int = LONGEST_CODE,
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode the texts of all rows and write their ids, with ``end_id`` after each, to ``folder``.

    Documents are in ascending order of ``id_col``, null first; of equal ids the one with fewer
    ids, then the smaller checksum goes first, and equal rows stay apart rows. A null or empty text
    is the end id alone. Other columns are not read, whatever their names. An empty table gives a
    folder of two empty tables. A document lies in one block, so a very long one makes a block of
    its size; all others end once they hold ``block_ids`` ids.

    The ids go to the shared folder once, two bytes each (four for large vocabularies), and are sorted
    by range, so equal or dense ids spread over tasks. Of the counts, one number for each id of the vocabulary
    reaches the driver.
    """
    spark = df.sparkSession
    width = _width(vocabulary)
    numbered = text_ids(df, vocabulary, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    ids = stage(numbered, compression="zstd")
    counts = global_counts(ids, width).orderBy("id").toArrow()
    symbols = counts["id"].to_numpy()
    lengths = code_lengths(counts["n"].to_numpy(), longest)
    listed = pa.table({"id": symbols.astype(np.int64), "bits": lengths.astype(np.int64)})
    spark.createDataFrame(listed).coalesce(1).write.parquet(f"{folder}/codes")
    key = symbols.astype(np.int64).tobytes(), lengths.astype(np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part, first = _book(*key), TaskContext.get().partitionId(), 0
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for piece in sliced(batches):
            flat, ends = _ids_of(piece.column(1), width)
            for k, doc in enumerate(piece.column(0).to_pylist()):
                docs.append((doc, flat[ends[k] : ends[k + 1]].copy()))
                held += len(docs[-1][1])
                if held >= block_ids:
                    yield _block(book, part, first, docs)
                    first, docs, held = first + held, [], 0
        if docs:
            yield _block(book, part, first, docs)

    by = [F.col("doc_id").asc_nulls_first(), F.col("length"), F.col("crc"), F.col("row")]
    ordered = ids.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "ids")
    schema = (
        "part int, first bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, "
        "checkpoints binary, bits binary"
    )
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def _decoded(book: Book, batch: pa.RecordBatch) -> np.ndarray:
    """The ids of all blocks of a batch in a row."""
    words, starts, counts, base = [], [], [], 0
    for n_ids, points, bits in zip(*(batch.column(k).to_pylist() for k in ("n_ids", "checkpoints", "bits"))):
        words.append(np.frombuffer(bits, ">u4"))
        starts.append(np.frombuffer(points, "<u8").astype(np.int64) + 32 * base)
        runs = np.full(len(starts[-1]), CHECKPOINT, np.int64)
        runs[-1:] = n_ids - CHECKPOINT * (len(runs) - 1)
        counts.append(runs)
        base += len(words[-1])
    return book.decode(np.concatenate([*words, np.zeros(1, ">u4")]), np.concatenate(starts), np.concatenate(counts))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` of what ``write_ids`` wrote.

    ``ids`` are little-endian unsigned 32-bit numbers. Blocks are decoded alone and in any order, from
    all their checkpoints at once; only the number of ids in each part is added up before.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    codes = spark.read.parquet(f"{folder}/codes").orderBy("id").toArrow()
    key = codes["id"].to_numpy().astype(np.int64).tobytes(), codes["bits"].to_numpy().astype(np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text=6):
            ids = _decoded(_book(*key), batch)
            sizes = batch.column("sizes").flatten().to_numpy()
            blocks_of = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("sizes").offsets.to_numpy()))
            ends = offsets_of(sizes)
            opens = offsets_of(batch.column("n_ids").to_numpy())[:-1]
            start = ends[:-1] - opens[blocks_of] + batch.column("first").to_numpy()[blocks_of]
            blobs = _blobs(ids.astype("<u4"), ends)
            part = pa.array(batch.column("part").to_numpy()[blocks_of])
            yield pa.record_batch(
                [batch.column("doc_ids").flatten(), part, pa.array(start), blobs], names=["doc_id", "part", "start", "ids"]
            )

    docs = blocks.mapInArrow(run, "doc_id bigint, part int, start bigint, ids binary")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row for each task that wrote, so it is small whatever the number of ids.
    joined = docs.join(F.broadcast(before), docs["part"] == before["of_part"])
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")
