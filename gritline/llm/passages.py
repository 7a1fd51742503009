"""Repeated passages, through a sparse suffix array whose positions the text itself selects."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gritline.llm.batches import offsets_of, sliced, texts
from gritline.operators.skew import stage

LEAST = 50  # words of a passage
KEY = 16  # words of a suffix that are compared first
GRAM = 5  # words that select a position
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 2 << 20  # bytes of text at a time; the arrays take some thirty times that
SLOTS = 64  # more than the windows that can select one position


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


@dataclass
class Words:
    """Words of a slice of texts in a row: hash, place in characters, and the words of each text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, and the end

    def __post_init__(self) -> None:
        n = len(self.hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _powers(BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(INVERSE, n)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to its end: a polynomial of the words' hashes, mixed."""
        out = (self.sums[end] - self.sums[start]) * self.back[start]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def words_of(contents: Sequence[bytes]) -> Words:
    """Runs of bytes other than ASCII white space, with A-Z in lower case."""
    parts = [t.lower() for t in contents]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)  # a blank after each text
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    tiles = np.append(edge, len(raw)).astype(np.int32)  # words and the white space between them
    runs = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(tiles), pa.py_buffer(raw)])
    coded = runs.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()[::2]]
    chars = offsets_of((raw & 0xC0) != 0x80)
    text_start = offsets_of(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    first = np.searchsorted(start, text_start)
    shift = np.repeat(chars[text_start[:-1]], np.diff(first))
    return Words(hashes, chars[start] - shift, chars[end] - shift, first)


@dataclass
class Runs:
    """Windows that select the same position: the first one's start, their number, and the position."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def contents(self, words: Words, least: int) -> np.ndarray:
        """Hash of all words that the windows of a run cover."""
        return words.between(self.start, self.start + self.count - 1 + least)


def runs_of(words: Words, least: int, key: int, gram: int) -> Runs:
    """All windows of ``least`` words, by the position that they select.

    A window selects the smallest hash of ``gram`` words among the positions that leave ``key`` words
    within it, the leftmost on ties. So equal windows select the same place, and a place is selected by
    consecutive windows.
    """
    n, reach = len(words.hashes), least - key + 1
    starts = np.concatenate(
        [np.zeros(0, np.int64), *[np.arange(a, b - least + 1) for a, b in zip(words.first, words.first[1:])]]
    )
    if not len(starts):
        return Runs(starts, starts, starts)
    rank = np.full(n, 2**64 - 1, np.uint64)
    inside = np.arange(n - gram + 1)
    rank[: len(inside)] = words.between(inside, inside + gram)
    rank = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= reach:
        rank = np.minimum(rank, np.append(rank[span:], np.full(min(span, n), 2**64 - 1, np.uint64))[:n])
        span *= 2
    chosen = np.minimum(rank[starts], rank[starts + reach - span]) & np.uint64(0xFFFFFFFF)
    begin = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)))
    count = np.diff(np.append(begin, len(starts)))
    return Runs(starts[begin], count, chosen[begin].astype(np.int64))


def suffixes(df: DataFrame, least: int, key: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """The retained suffixes: ``id``, ``at``, ``key`` and ``full``.

    ``at`` is the word at which the run of windows that select the suffix starts, times ``SLOTS``, plus
    the windows in the run; ``key`` stands for the first words of the suffix, ``full`` for all words of
    the run: the suffix extended to the left and right as far as its windows go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, limit=SLICE):
            words = words_of([t.encode() for t in part.column(1).to_pylist()])
            runs = runs_of(words, least, key, gram)
            text = np.searchsorted(words.first, runs.start, "right") - 1
            columns = [
                part.column(0).take(pa.array(text)),
                pa.array((runs.start - words.first[text]) * SLOTS + runs.count),
                pa.array(words.between(runs.anchor, runs.anchor + key).view(np.int64)),
                pa.array(runs.contents(words, least).view(np.int64)),
            ]
            yield pa.record_batch(columns, names=["id", "at", "key", "full"])

    rows = texts(df, id_col, text_col).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, at bigint, key bigint, full bigint")


def neighbours(sorted_rows: DataFrame) -> DataFrame:
    """Of rows sorted by key within partitions, those whose neighbour has the same key.

    The first and the last row of a partition stay too, as their neighbours are elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it is to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.append(False, same) | np.append(same, False)
            if held is None:
                keep[0] = True
            else:
                row, stays = held
                equal = row.column("key")[0].as_py() == key[0]
                keep[0] |= equal
                if stays or equal:
                    yield row
            last = batch.num_rows - 1
            held = batch.slice(last, 1), bool(keep[last])
            keep[last] = False
            yield batch.filter(pa.array(keep))
        if held is not None:
            yield held[0]

    return sorted_rows.mapInArrow(run, sorted_rows.schema)


def _pressed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the compressed text, for a join that moves texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in sliced(batches):
            data = [press(t.encode()) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return texts(df, id_col, text_col).where("id IS NOT NULL").mapInArrow(run, "id bigint, data binary")


def _contents(column: pa.BinaryArray) -> list[bytes]:
    unpress = zstandard.ZstdDecompressor().decompress
    return [unpress(t) for t in column.to_pylist()]


def windows(df: DataFrame, probes: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """All windows of the runs in ``probes``: ``key``, ``of`` and the run's ``lo`` and ``hi``.

    ``of`` is the run's number times ``SLOTS`` plus the window's place in it. A run is read in the
    document ``lo``.
    """
    # As many runs as a document has suffixes at most.
    wanted = probes.groupBy(F.col("lo").alias("id")).agg(F.collect_list(F.struct("at", "run", "hi")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, limit=SLICE // 2):
            words = words_of(_contents(part.column("data")))
            lists = part.column("runs")
            text = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            at, number, hi = (lists.flatten().field(k).to_numpy() for k in range(3))
            fits = at // SLOTS + at % SLOTS - 1 + least <= np.diff(words.first)[text]  # another row with this id
            text, at, number, hi = text[fits], at[fits], number[fits], hi[fits]
            count = at % SLOTS
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(words.first[text] + at // SLOTS, count) + place
            columns = [
                pa.array(words.between(start, start + least).view(np.int64)),
                pa.array(np.repeat(number, count) * SLOTS + place),
                part.column("id").take(pa.array(np.repeat(text, count))),
                pa.array(np.repeat(hi, count)),
            ]
            yield pa.record_batch(columns, names=["key", "of", "lo", "hi"])

    picked = _pressed(df, id_col, text_col).join(wanted, "id").select("id", "data", "runs")
    return picked.mapInArrow(run, "key bigint, of bigint, lo bigint, hi bigint")


def repeated_passages(
    df: DataFrame, least: int = LEAST, key: int = KEY, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per maximal passage that is covered by windows of ``least`` words found in other rows.

    ``id_col``, ``passage`` (from 1), ``word`` (its first one, from 0), ``n_words``, ``first_id`` (the
    smallest id that has one of its windows) and ``is_first`` (no smaller id has any). Words are
    separated by ASCII white space and compared with A-Z in lower case. Texts of fewer words, null and
    empty ones have no passage. Passages repeated within one id only, and rows with a null id, take no
    part; rows that repeat an id with the same text are one document. Other columns are not read.

    Suffixes are kept at minimisers. They are sorted by range, so that a passage in a third of all rows
    spreads over many tasks, and neighbours are compared by their first words. A match is extended to
    the left and right as far as the windows go that select it. Where all equal suffixes have the same
    extension, that settles them at once, and copies of a document cost one row per suffix. Elsewhere,
    one of each different extension is compared window by window. No window is left out: equal windows
    select equal suffixes. Equality is that of 64-bit hashes.
    """
    found = stage(suffixes(df, least, key, gram, id_col, text_col))
    matched = stage(
        neighbours(found.repartitionByRange("key", "full", "id").sortWithinPartitions("key", "full", "id"))
    )
    kinds = stage(
        matched.groupBy("key", "full")
        .agg(F.min(F.struct("id", "at")).alias("one"), F.max("id").alias("hi"))
        .select("key", "full", F.col("one.id").alias("lo"), F.col("one.at").alias("at"), "hi")
    )
    mixed = kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    probes = stage(kinds.join(mixed, "key", "left_semi").withColumn("run", F.monotonically_increasing_id()))
    around = stage(windows(df, probes, least, id_col, text_col))
    shared = stage(
        around.groupBy("key").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"))
        .where("first_id < last_id").select("key", "first_id")
    )
    hits = (
        around.join(shared, "key")
        .groupBy(F.shiftright("of", 6).alias("run"))
        .agg(F.array_sort(F.collect_list(F.struct((F.col("of") % SLOTS).alias("i"), "first_id"))).alias("hits"))
    )
    count = F.col("at") % SLOTS
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), (count - 1).alias("j"), F.array_min("hits.first_id").alias("f")))
    each = F.transform("hits", lambda h: F.struct(h.i.alias("i"), h.i.alias("j"), h.first_id.alias("f")))
    by_window = probes.join(hits, "run").select("key", "full", F.when(F.size("hits") == count, whole).otherwise(each).alias("parts"))
    settled = kinds.where("lo < hi").join(probes.select("key").distinct(), "key", "left_anti").select(
        "key", "full", F.array(F.struct(F.lit(0).cast("bigint").alias("i"), (count - 1).alias("j"), F.col("lo").alias("f"))).alias("parts")
    )
    known = stage(by_window.unionByName(settled))
    parts = matched.join(known, ["key", "full"]).select("id", F.shiftright("at", 6).alias("word"), F.inline("parts"))
    order = Window.partitionBy("id").orderBy("first", "last")
    spans = parts.select("id", (F.col("word") + F.col("i")).alias("first"), (F.col("word") + F.col("j")).alias("last"), "f")
    opens = F.col("first") > F.coalesce(F.lag("last").over(order), F.lit(-least - 1)) + least
    numbered = spans.withColumn("opens", opens.cast("int")).withColumn("passage", F.sum("opens").over(order))
    return (
        numbered.groupBy("id", "passage")
        .agg(F.min("first").alias("word"), (F.max("last") - F.min("first") + least).alias("n_words"), F.min("f").alias("first_id"))
        .select(
            F.col("id").alias(id_col), F.col("passage").cast("int").alias("passage"), F.col("word").cast("int").alias("word"),
            F.col("n_words").cast("int").alias("n_words"), "first_id", (F.col("first_id") == F.col("id")).alias("is_first"),
        )
    )


def passage_texts(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``passage``, ``start``, ``end`` (characters, end exclusive) and ``text`` of passages found."""
    wanted = found.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct("passage", "word", "n_words")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, limit=SLICE // 2):
            contents = _contents(part.column("data"))
            words = words_of(contents)
            rows = []
            for k, spans in enumerate(part.column("spans").to_pylist()):
                text = contents[k].decode()
                for span in spans:
                    at = words.first[k] + span["word"]
                    a, b = int(words.start[at]), int(words.end[at + span["n_words"] - 1])
                    rows.append((part.column("id")[k].as_py(), span["passage"], a, b, text[a:b]))
            names = [id_col, "passage", "start", "end", "text"]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    picked = _pressed(df, id_col, text_col).join(wanted, "id").select("id", "data", "spans")
    return picked.mapInArrow(run, f"{id_col} bigint, passage int, start int, end int, text string")
