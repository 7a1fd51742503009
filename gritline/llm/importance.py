"""Importance resampling towards a target: hashed n-grams from running checksums, one draw without repeats."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.llm.batches import map_text, offsets_of, sliced
from gritline.operators.skew import position_in_group, stage

SEPARATOR = b" "


@functools.cache
def _lower() -> np.ndarray:
    """Each byte, with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@functools.cache
def _of_word() -> np.ndarray:
    """Whether a lower-case byte belongs to a word: digits, a-z and all of what isn't ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for first, last in ("09", "az"):
        table[ord(first) : ord(last) + 1] = True
    return table


@functools.cache
def _shift_tables(power: int) -> np.ndarray:
    """The checksum's change by 2**power zero bytes, for each value of each of its four bytes.

    That change is linear over GF(2), so a checksum's is the sum of its bytes' changes, and the
    tables of twice as many zero bytes come from applying these twice.
    """
    if power:
        half = _shift_tables(power - 1)
        return _apply(half, half)
    none = zlib.crc32(b"\0")
    return np.array([[zlib.crc32(b"\0", b << 8 * k) ^ none for b in range(256)] for k in range(4)], np.uint32)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What each checksum adds to that of a string in which ``zeros`` more bytes follow."""
    out = crc.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero(zeros >> power & 1)
        out[some] = _apply(_shift_tables(power), out[some])
    return out


class Scanned:
    """Words of a slice of texts, and the running checksums at their ends and starts.

    Each text is normalised to its lower-case words with one separator between them, and scanned
    once. ``first`` says which words are whose: those of text k are first[k] to first[k + 1].
    """

    def __init__(self, raw: np.ndarray, edges: np.ndarray):
        low = _lower()[raw]
        inside = _of_word()[low]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        heads = edges[:-1][edges[:-1] < len(raw)]
        opens[heads] = inside[heads]
        begin = np.flatnonzero(opens)
        kept = np.append(np.cumsum(inside, dtype=np.int64), inside.sum()) if len(raw) else np.zeros(1, np.int64)
        before = kept[begin] - 1  # letters before each word
        size = np.diff(np.append(before, kept[-1]))
        self.first = np.searchsorted(begin, edges)
        self.ends = np.cumsum(size + 1) - 1  # in the normalised texts, which stand one behind the other
        self.starts = self.ends - size
        normal = np.full(int(size.sum()) + len(size), SEPARATOR[0], np.uint8)
        at = np.repeat(np.arange(len(size)), size)
        normal[np.arange(len(at)) + at] = low[inside]
        self.at_end = self._scan(normal)
        self.at_start = shifted(self.at_end, np.ones(len(size), np.int64)) ^ np.uint32(zlib.crc32(SEPARATOR))
        self.at_start = np.append(np.uint32(0), self.at_start[:-1])[: len(size)]
        self.at_start[self.first[:-1][np.diff(self.first) > 0]] = 0

    def _scan(self, normal: np.ndarray) -> np.ndarray:
        view, crc32 = memoryview(normal), zlib.crc32
        out: list[int] = []
        starts, ends = self.starts.tolist(), self.ends.tolist()
        for k in np.flatnonzero(np.diff(self.first)):
            crc, done = 0, starts[self.first[k]]
            for end in ends[self.first[k] : self.first[k + 1]]:
                crc = crc32(view[done:end], crc)
                out.append(crc)
                done = end
        return np.array(out, np.uint32)

    def grams(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Checksums of all runs of 1 to ``longest`` words, text by text, and where each text begins.

        The checksum of a run is what is left of the one at its end after the one at its start,
        moved past the run, cancels what came before.
        """
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        crcs, texts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for more in range(longest):
            last = np.arange(more, len(owner))
            last = last[owner[last - more] == owner[last]]
            head = last - more
            length = self.ends[last] - self.starts[head]
            crcs.append(self.at_end[last] ^ shifted(self.at_start[head], length))
            texts.append(owner[last])
        all_texts = np.concatenate(texts)
        order = np.argsort(all_texts, kind="stable")
        counts = np.bincount(all_texts, minlength=len(self.first) - 1)
        return np.concatenate(crcs)[order], offsets_of(counts)


def scan(batch: pa.RecordBatch, text: int = 1) -> Scanned:
    column = batch.column(text)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return Scanned(raw, ends - ends[0])


def features(
    df: DataFrame, longest: int, buckets: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``words`` and ``codes`` of every row: the bucket of each run of 1 to ``longest`` words.

    ``codes`` are little-endian unsigned 32-bit numbers. A null or empty text has none. Rows are
    independent: repeated rows stay, an empty table gives an empty one, and other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan(batch)
        crcs, ends = found.grams(longest)
        codes = (crcs % np.uint32(buckets)).astype("<u4")
        blobs = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(codes)]
        )
        words = pa.array(np.diff(found.first))
        return pa.record_batch([batch.column(0), words, blobs], names=["id", "words", "codes"])

    return map_text(df, work, "id bigint, words bigint, codes binary", id_col, text_col)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a column of them in a row, and where each row's begin."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", "<u4")[ends[0] // 4 : ends[-1] // 4], (ends - ends[0]) // 4


def bucket_counts(coded: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``n`` over all rows of ``features``; a task sends at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in sliced(batches, text=0):
            total += np.bincount(_numbers(part.column(0))[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counts = coded.select("codes").mapInArrow(run, "bucket bigint, n bigint")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths: the log of how much more the target has of it.

    Both tables are those of ``bucket_counts``. The result has ``buckets`` numbers, whatever the
    input's size, and travels with the tasks that weigh documents.
    """
    spark = source.sparkSession
    s_all, t_all = (c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in (source, target))
    joined = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
    )

    def smoothed(column: str) -> Column:
        return F.coalesce(column, F.lit(0)).cast("double") + 1.0

    ratio = smoothed("t") * F.lit(float(s_all + buckets)) / (smoothed("s") * F.lit(float(t_all + buckets)))
    table = joined.select("bucket", F.floor(F.log(ratio) * 1000.0).cast("bigint").alias("gain")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    return out


def weigh(coded: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id``, ``words``, ``n_features`` and ``weight``, the sum of the gains of a row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text=2):
            codes, ends = _numbers(part.column(2))
            sums = offsets_of(gain[codes])
            columns = [part.column(0), part.column(1), pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))]
            yield pa.record_batch(columns, names=["id", "words", "n_features", "weight"])

    schema = "id bigint, words bigint, n_features bigint, weight bigint"
    return coded.select("id", "words", "codes").mapInArrow(run, schema)


def noise(seed: int, id_col: str = "id") -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id; a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    uniform = (h + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(uniform)) * -1000.0).cast("bigint")


def resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 10,
    longest: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Draw rows of ``df`` that look like ``target``: all rows with ``n_features``, ``weight``, ``score``, ``rank``.

    Features are runs of 1 to ``longest`` lower-case words, hashed to ``buckets``. A row's weight is
    the log likelihood ratio of its features under add-one counts of both tables, its score adds
    Gumbel noise, and the ``percent`` % highest scores among rows of ``least_words`` words or more are
    drawn without repeats. ``rank`` counts them from 1 and is null for the rest.

    Null and empty texts have no features and weight 0. A null id is one more id, hashed as an empty
    one and ranked before others on equal scores. Of rows that tie in score and id, the one with fewer
    features, then the smaller weight goes first; equal rows stay apart rows. Empty tables give empty
    results, an empty target smoothed counts only. Other columns are not read, whatever their names.

    Texts are scanned once; what is kept of them is written to the shared folder, four bytes a feature.
    """
    coded = stage(features(df, longest, buckets, id_col, text_col))
    wanted = target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text"))
    of_target = features(wanted, longest, buckets, "id", "text")
    gain = gains(stage(bucket_counts(coded, buckets)), stage(bucket_counts(of_target, buckets)), buckets)
    fits = (F.col("words") >= least_words).alias("fits")
    drawn = coded.where(F.col("words") >= least_words).count() * percent // 100
    scored = weigh(coded, gain).select("id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), fits)
    order = [F.desc("fits"), F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight")]
    placed = position_in_group(scored, [], order, "place")
    return placed.select(
        F.col("id").alias(id_col), "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place").cast("bigint")).alias("rank"),
    )
