"""Token counts: pre-tokens that are one token are counted without merging them."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gritline.llm.batches import map_text
from gritline.llm.bpe import normal
from gritline.llm.pretokens import Known, pretokens, segments
from gritline.llm.vocabulary import load, read


def prove_whole(vocabulary: str) -> frozenset[bytes]:
    """The words that merging turns into exactly one token.

    A vocabulary string needn't encode as itself: an earlier merge may cross its parts. So each
    is merged from its bytes once, on the driver; the result has the size of the vocabulary.
    """
    return _whole(read(vocabulary))


@functools.lru_cache(maxsize=2)
def _whole(packed: bytes) -> frozenset[bytes]:
    tables = load(packed)
    return frozenset(w for w, token in tables.final.items() if tables.merge(w) == (token,))


class Counter:
    def __init__(self, packed: bytes, whole: frozenset[bytes]):
        self.v, self.whole = load(packed), whole
        self.known = Known({s.encode(): (1,) for s in self.v.specials})

    def _sizes(self, words: list[bytes]) -> list[tuple[int]]:
        whole, merge = self.whole, self.v.merge
        return [(1,) if w in whole else (len(merge(w)),) for w in words]

    def count(self, texts: Sequence[str]) -> np.ndarray:
        parts, owner, special = segments(texts, tuple(self.v.specials))
        if self.v.lowers:
            parts = [p if s else normal(p) for p, s in zip(parts, special)]
        pieces = pretokens(parts, special, self.v.glue_blank)
        if not len(pieces.codes):
            return np.zeros(len(texts), np.int64)
        places = self.known.index(pieces.words, self._sizes)  # one number for each word
        sizes = self.known.flat[places]
        return np.bincount(owner[pieces.segment], sizes[pieces.codes], len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _counter(packed: bytes, whole: frozenset[bytes]) -> Counter:
    return Counter(packed, whole)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``n_tokens`` of every row.

    A null or empty text has none. Rows are independent: repeated rows stay, an empty table gives
    an empty one, and other columns are not read. Long texts are cut where no pre-token changes.
    """
    packed, whole = read(vocabulary), prove_whole(vocabulary)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(1)
        sizes = pc.binary_length(text).cast(pa.int64())
        counts = pa.array(_counter(packed, whole).count(text.to_pylist()))
        return pa.record_batch([batch.column(0), sizes, counts], names=[id_col, "n_bytes", "n_tokens"])

    return map_text(df, work, f"{id_col} bigint, n_bytes bigint, n_tokens bigint", id_col, text_col)
