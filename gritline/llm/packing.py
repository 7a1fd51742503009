"""Cut documents into token pieces and pack the pieces into sequences by vector best fit."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritline.llm.batches import gather, map_text, offsets_of
from gritline.llm.pretokens import Known, pretokens, segments
from gritline.llm.vocabulary import load, read
from gritline.operators.skew import stage

BLOCK_ROWS = 4096
WEIGHTS = (1.0, 0.2, 0.2)  # of tokens, documents and attention


class ByteEncoder:
    """Ids of a byte-level vocabulary; each distinct pre-token is encoded once."""

    def __init__(self, packed: bytes):
        tables = load(packed)
        self.specials = tables.specials
        ranks = {w: t for w, t in tables.middle.items()}
        self.core = tiktoken.Encoding("bytes", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.known = Known({s.encode(): (t,) for s, t in tables.specials.items()})

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        single = self.core._encode_single_piece
        return [single(w) for w in words]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins in them."""
        parts, owner, special = segments(texts, tuple(self.specials))
        pieces = pretokens(parts, special, glue_blank=True)
        places = self.known.index(pieces.words, self._learn)
        ids, ends = gather(places[pieces.codes], self.known.starts, self.known.flat)
        if not len(ids):
            return ids, np.zeros(len(texts) + 1, np.int64)
        return ids, offsets_of(np.bincount(owner[pieces.segment], np.diff(ends), len(texts)).astype(np.int64))


@functools.lru_cache(maxsize=2)
def byte_encoder(packed: bytes) -> ByteEncoder:
    return ByteEncoder(packed)


def token_pieces(
    df: DataFrame, vocabulary: str, tokens: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length`` and ``ids`` of pieces of at most ``tokens`` ids.

    ``ids`` are little-endian unsigned 32-bit numbers. A document's ids end in ``end_id``, so a
    null or empty text has one piece of one id. Only longer documents are cut; all pieces but
    the first are full. Rows are independent: repeated rows stay, other columns are not read.
    """
    packed = read(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = byte_encoder(packed).encode(batch.column(1).to_pylist())
        ids = np.insert(ids, ends[1:], end_id).astype("<u4")
        length = np.diff(ends) + 1
        pieces = -(-length // tokens)
        doc = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head = (length - (pieces - 1) * tokens)[doc]
        size = np.where(nth == 0, head, tokens)
        start = np.where(nth == 0, 0, head + (nth - 1) * tokens)
        edges = pa.py_buffer((offsets_of(size) * 4).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(size), [None, edges, pa.py_buffer(ids)])
        return pa.record_batch(
            [batch.column(0).take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(start), pa.array(size), blobs],
            names=[id_col, "piece", "start", "length", "ids"],
        )

    schema = f"{id_col} bigint, piece int, start bigint, length bigint, ids binary"
    return map_text(df, work, schema, id_col, text_col)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin for each row of ``demand`` (items x resources).

    Items come largest first. Among the open bins in which every resource suffices, ``norm``
    takes the one that the item leaves with the smallest weighted norm of its residuals, ``dot``
    the one whose residuals have the largest weighted dot product with the demand.
    """
    scaled_by = weights / capacity**2
    order = np.lexsort((*demand.T[::-1], -demand[:, 0]))
    order = order[np.argsort(-demand[order, 0], kind="stable")]
    least = demand.min(axis=0) if len(demand) else capacity
    left = np.empty((len(demand), demand.shape[1]))
    bins = np.empty(len(demand), np.int64)
    place = np.empty(len(demand), np.int64)
    filled = np.zeros(len(demand), np.int64)
    active, used = np.zeros(0, np.int64), 0
    for item in order:
        need = demand[item]
        fits = active[(left[active] >= need).all(axis=1)] if len(active) else active
        if len(fits):
            residual = left[fits]
            if rule == "dot":
                chosen = fits[np.argmax(residual @ (need * scaled_by))]
            else:
                chosen = fits[np.argmin((residual - need) ** 2 @ scaled_by)]
        else:
            chosen, used = used, used + 1
            left[chosen] = capacity
            active = np.append(active, chosen)
        left[chosen] -= need
        bins[item], place[item] = chosen, filled[chosen]
        filled[chosen] += int(need[0])
        if (left[chosen] < least).any():  # nothing fits any more
            active = active[active != chosen]
    return bins, place


def pack(
    pieces: DataFrame,
    tokens: int,
    documents: int | None = None,
    attention: int | None = None,
    weights: Sequence[float] = (1.0, 0.0, 0.0),
    rule: str = "norm",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of at most ``tokens``.

    A sequence holds at most ``tokens`` tokens, ``documents`` pieces and ``attention`` units of
    the sum of squared lengths; without a number, a resource can't run out before tokens do.
    ``weights`` are those of the three resources in ``rule`` (see ``best_fit``).

    Rows are dealt into blocks of about ``block_rows`` by a hash of their place in the table, so equal rows
    spread, too, and each block is packed alone. A block wastes about one sequence, so the total is within a
    fraction of a percent of one large packing, and no task grows with the table. Equal rows stay apart rows,
    an empty table gives an empty one. All other columns are kept; a table that has one of the two new ones, or a
    null length, is refused.
    """
    taken = {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}
    if taken:
        raise ValueError(f"the table already has {', '.join(sorted(taken))}")
    own = "block"
    while own in {c.lower() for c in pieces.columns}:
        own += "_"
    blocks = max(1, -(-pieces.count() // block_rows))
    capacity = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    weigh = np.array(weights, float)

    def work(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy().astype(float)
        demand = np.stack([length, np.ones_like(length), length**2], axis=1)
        bins, place = best_fit(demand, capacity, weigh, rule)
        block = table[own][0].as_py()
        out = table.drop_columns(own)
        return out.append_column("sequence_id", pa.array((block << 32) + bins)).append_column("offset", pa.array(place))

    keyed = pieces.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return keyed.groupBy(own).applyInArrow(work, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, vocabulary: str, tokens: int, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Pieces of all documents with their checksum, place and sequence (without the ids).

    Documents and attention weigh in the choice of a sequence, but have as much room as ``tokens`` leaves them: a tighter
    limit would take more sequences. Other columns of ``df`` are not read, whatever their names; null text is empty.
    """
    pieces = token_pieces(df, vocabulary, tokens)
    listed = stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(listed, tokens, documents=tokens, attention=tokens * tokens, weights=weights)
