"""SimHash fingerprints, and links between them found by chains of segments on a ring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.llm.batches import map_text
from gritline.llm.components import components
from gritline.operators.skew import apart, counted, salted_join, stage

BITS = 64
DENSE_BUCKET = 128
WINDOW = 1 << 20
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all runs of ``words`` words, as big-endian bytes, one row for each.

    A-Z is lower-cased, words are separated by ASCII white space and joined by one blank. Fewer
    words are one shingle, no word is none. Long texts are read in windows that overlap.
    """
    digest = xxhash.xxh64_digest
    data, out, carry, start = text.encode().lower(), [], [], 0
    while start < len(data) or not start:
        stop = min(len(data), start + WINDOW)
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        found = carry + data[start:stop].split()
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        begins = np.append(0, ends[:-1] + 1)
        if len(found) >= words:
            spans = zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
            out.extend([digest(joined[a:b], seed) for a, b in spans])
            carry = found[len(found) - words + 1 :]
        else:
            carry = found
        start = max(stop, 1)
    if not out and carry:
        out.append(digest(b" ".join(carry), seed))
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 8) if out else np.zeros((0, 8), np.uint8)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of hashes (rows of 8 bytes): the bits set in over half of them, as a signed number."""
    if not len(hashes):
        return 0
    cells = (hashes + np.arange(8) * 256).ravel()
    counts = np.bincount(cells, minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes)).tobytes(), "big", signed=True)


def remix(hashes: np.ndarray, nth: int) -> np.ndarray:
    """Another 64 bits for each hash; the first are its own."""
    if not nth:
        return hashes
    odd = (nth * 0x9E3779B97F4A7C15) % (1 << 64) | 1
    x = hashes.view(">u8").astype(np.uint64)
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(odd)
    x ^= x >> np.uint64(32)
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)


def fingerprints(
    df: DataFrame, words: int, count: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``fp0``, ``fp1``, ... of every row; ``distinct`` counts each shingle once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, words)
            if distinct:
                hashes = np.unique(hashes.view(">u8")).view(np.uint8).reshape(-1, 8)
            rows.append([majority(remix(hashes, k)) for k in range(count)])
        table = np.array(rows, np.int64).reshape(-1, count)
        return pa.record_batch(
            [batch.column(0), *[pa.array(table[:, k]) for k in range(count)]], names=["id", *names]
        )

    names = [f"fp{k}" for k in range(count)]
    return map_text(df, work, ", ".join(["id bigint", *[f"{n} bigint" for n in names]]), id_col, text_col)


@dataclass(frozen=True)
class Ring:
    """``BITS`` bits in ``radius + 1`` segments on a ring.

    If at most ``radius`` bits differ, some segment starts a chain in which the first j segments
    differ in at most j * radius / (radius + 1) bits, for every j. Chains of ``indexed`` segments
    are found by joining; longer ones are checked pair by pair.
    """

    radius: int = 4
    indexed: int = 2

    @property
    def sizes(self) -> list[int]:
        m = self.radius + 1
        return [BITS // m + (k < BITS % m) for k in range(m)]

    def budget(self, length: int) -> int:
        return length * self.radius // (self.radius + 1)

    def chain(self, first: int, length: int) -> tuple[int, list[int]]:
        """Where the chain begins, and the sizes of its segments in order."""
        sizes = self.sizes
        return sum(sizes[:first]), [sizes[(first + k) % len(sizes)] for k in range(length)]

    def flips(self, sizes: list[int]) -> list[int]:
        """All differences of a chain that keep to the budgets, as bit masks."""
        found, low = [(0, 0)], 0
        for length, size in enumerate(sizes, 1):
            budget, bits = self.budget(length), [1 << (low + k) for k in range(size)]
            grown = [(0, 0)]
            out = []
            for _ in range(budget + 1):
                out += grown
                grown = [(m | b, n + 1) for m, n in grown for b in bits if b > m]
            found = [(a | b, x + y) for a, x in found for b, y in out if x + y <= budget]
            low += size
        return [mask for mask, _ in found]


def _rotated(fp: Column, by: int) -> Column:
    if not by:
        return fp
    return F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, BITS - by))


def _keys(ring: Ring, fp: Column, near: bool) -> Column:
    """Keys of all chains: the segments' bits and the chain's number; ``near`` also those in reach."""
    keys = []
    for first in range(ring.radius + 1):
        offset, sizes = ring.chain(first, ring.indexed)
        own = _rotated(fp, offset).bitwiseAND(F.lit((1 << sum(sizes)) - 1)).bitwiseOR(F.lit(first << 58))
        keys += [own.bitwiseXOR(F.lit(m)) for m in ring.flips(sizes)] if near else [own]
    return F.array(*keys)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _in_budget(ring: Ring, key: Column, a: Column, b: Column) -> Column:
    """The chain that gave the key keeps to its budgets at every length."""
    apart = a.bitwiseXOR(b)
    found = F.lit(False)
    for first in range(ring.radius + 1):
        keeps = F.shiftright(key, 58) == first
        for length in range(ring.indexed + 1, ring.radius + 1):
            offset, sizes = ring.chain(first, length)
            part = _rotated(apart, offset).bitwiseAND(F.lit((1 << sum(sizes)) - 1))
            keeps &= F.bit_count(part) <= ring.budget(length)
        found |= keeps
    return found


def _ball(fp: Column) -> Column:
    """All codes at a distance of at most 2."""
    one = [1 << k if k < 63 else -(1 << 63) for k in range(BITS)]
    bits = F.array(*[F.lit(b) for b in one])
    single = F.transform(bits, lambda b: fp.bitwiseXOR(b))
    pairs = F.transform(
        bits, lambda b, k: F.transform(F.slice(bits, k + 2, BITS), lambda c: fp.bitwiseXOR(b).bitwiseXOR(c))
    )
    return F.concat(F.array(fp), single, F.flatten(pairs))


def linked(codes: DataFrame, ring: Ring, dense_bucket: int = DENSE_BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of codes (``fp``, distinct) in reach.

    Codes meet in the buckets of their chains, and only pairs in which the chain keeps to its
    budgets at every length are compared in full. A bucket of over ``dense_bucket`` codes gives no
    pairs, as a group of near copies would give them all: its codes, and those in reach of it, go
    by ``_dense`` instead. So every link is kept, either as a pair or as a path.
    """
    exact = codes.select("fp", F.explode(_keys(ring, F.col("fp"), False)).alias("key"))
    near = codes.select(F.col("fp").alias("a"), F.explode(_keys(ring, F.col("fp"), True)).alias("key"))
    dense = stage(exact.groupBy("key").count().where(F.col("count") > dense_bucket).select("key"))
    crowded = not dense.isEmpty()
    if crowded:
        dense = counted(dense)
    light = exact.join(dense, "key", "left_anti") if crowded else exact
    pairs = near.join(
        apart(light.select(F.col("fp").alias("b"), F.col("key").alias("of"))),
        (F.col("key") == F.col("of"))
        & (F.col("a") < F.col("b"))
        & _in_budget(ring, F.col("key"), F.col("a"), F.col("b"))
        & (differing(F.col("a"), F.col("b")) <= ring.radius),
    ).select("a", "b")
    if not crowded:
        return pairs
    members = near.join(dense, "key", "left_semi").select(F.col("a").alias("fp")).distinct()
    return pairs.unionByName(_dense(members, ring))


def _dense(members: DataFrame, ring: Ring) -> DataFrame:
    """Links for codes that are many and close: two codes at most 4 apart have a code between them
    that is at most 2 from both, so codes that share such a code are linked through one of them.

    At most 2,081 codes are around a shared one, and any two of them are in reach.
    """
    if ring.radius != 4:
        raise ValueError("dense buckets need a radius of 4")
    around = members.select("fp", F.explode(_ball(F.col("fp"))).alias("code"))
    shared = around.groupBy("code").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    return shared.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 1 << 30)).alias("b")).distinct()


def near_components(
    df: DataFrame,
    words: int = 4,
    ring: Ring = Ring(),
    id_col: str = "doc_id",
    text_col: str = "text",
    dense_bucket: int = DENSE_BUCKET,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints with at most ``ring.radius`` differing bits are linked, and a component has the
    smallest id that links lead to. A null or empty text has no word and fingerprint zero, which
    is linked like any other. Equal fingerprints are one node, so copies cost nothing. Rows that
    repeat an id are rows like others; null ids have a component but don't name one, unless
    there is no other (then it is null). Other columns are not read; no rows give no rows.
    """
    rows = stage(fingerprints(df, words, 1, False, id_col, text_col).withColumnRenamed("fp0", "fp"))
    codes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = stage(components(linked(codes.select("fp"), ring, dense_bucket)))
    named = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stage(salted_join(named, names, ["root"], ["fp"]).select("fp", "component_id"))
    return rows.join(labels, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )

