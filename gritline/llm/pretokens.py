"""Cut texts into pre-tokens, for a whole slice of documents at a time.

Both patterns of the public tokenizers are runs of one class of character with a few
exceptions, so the cuts come from comparing neighbouring characters in numpy.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = range(4)
# The code points with the property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
APOSTROPHE, BLANK = 0x27, 0x20
LONG_TEXT = 1 << 20
# Between two letters a blank always starts or separates pre-tokens, so a text may be cut before it.
_CUT = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[list(WHITE_SPACE)] = SPACE
    return table


@dataclass
class Pieces:
    """Pre-tokens of a slice: ``codes`` into ``words`` and the segment of each."""

    codes: np.ndarray
    words: pa.Array
    segment: np.ndarray


def cut_long(text: str, limit: int = LONG_TEXT) -> list[str]:
    """Cut a very long text where a cut changes no pre-token."""
    out, start = [], 0
    while len(text) - start > limit:
        found = _CUT.search(text, start + limit)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def segments(texts: Sequence[str], specials: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Split texts at special strings; returns segments, their text and whether each is a special one."""
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
    parts: list[str] = []
    owner: list[int] = []
    special: list[bool] = []
    for k, text in enumerate(texts):
        pieces = pattern.split(text) if specials and any(s in text for s in specials) else [text]
        for j, piece in enumerate(pieces):
            for part in [piece] if j % 2 or len(piece) <= LONG_TEXT else cut_long(piece):
                if part:
                    parts.append(part)
                    owner.append(k)
                    special.append(j % 2 == 1)
    return parts, np.array(owner, np.int64), np.array(special, bool)


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    table = classes()
    kind = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        top = raw[lead]
        size = 2 + (top >= 0xE0) + (top >= 0xF0)
        point = (top & (0x7F >> size)).astype(np.int64)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | (raw[lead[more] + k] & 0x3F)
        found = table[point]
        kind[lead] = found
        for k in range(1, 4):
            more = size > k
            kind[lead[more] + k] = found[more]
    return kind


def pretokens(parts: Sequence[str], special: np.ndarray, glue_blank: bool) -> Pieces:
    """Pre-tokens of all segments, none of which is empty.

    ``glue_blank``: a blank belongs to the run after it, number runs stay together and white
    space is kept. Otherwise numbers are single characters and white space is dropped.
    A special segment is one piece.
    """
    if not parts:
        return Pieces(np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64))
    encoded = [p.encode() for p in parts]
    raw = np.frombuffer(b"".join(encoded), np.uint8)
    n = len(raw)
    kind = _kinds(raw)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    first = np.cumsum(lengths) - lengths
    opens = np.zeros(n + 1, bool)  # a segment starts here
    opens[first] = True
    opens[n] = True
    start = opens[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if glue_blank:
        # The last white space before a run: on its own, or part of that run if it is a blank.
        runs = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
        blank = raw[runs] == BLANK
        start[runs[blank]] = True
        start[runs[blank] + 1] = False
        for at in runs[~blank]:
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            start[at] = True
    else:
        start |= (kind == NUMBER) & (raw & 0xC0 != 0x80)
    _contractions(raw, kind, opens, start)
    for k in np.flatnonzero(special):
        start[first[k] + 1 : first[k] + lengths[k]] = False
        kind[first[k] : first[k] + lengths[k]] = OTHER
    if not glue_blank:  # drop white space before anything is hashed
        keep = kind != SPACE
        lengths = np.add.reduceat(keep, first, dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        raw, start = raw[keep], start[keep]
    begin = np.flatnonzero(start)
    ends = np.append(begin, len(raw)).astype(np.int32)
    tiles = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])
    coded = tiles.dictionary_encode()
    edges = np.append(np.searchsorted(begin, first), len(begin))
    segment = np.repeat(np.arange(len(first)), np.diff(edges))
    return Pieces(coded.indices.to_numpy(), coded.dictionary, segment)


def _contractions(raw: np.ndarray, kind: np.ndarray, opens: np.ndarray, start: np.ndarray) -> None:
    """Join 's 't 'm 'd 're 've 'll where an apostrophe starts a pre-token."""
    n = len(raw)
    alone = np.flatnonzero((raw == APOSTROPHE) & start)
    alone = alone[alone + 1 < n]
    alone = alone[(kind[alone + 1] == LETTER) & ~opens[alone + 1]]
    one = alone[np.isin(raw[alone + 1], [ord(c) for c in "stmd"])]
    pairs = alone[alone + 2 < n]
    pairs = pairs[(kind[pairs + 2] == LETTER) & ~opens[pairs + 2]]
    first, second = raw[pairs + 1], raw[pairs + 2]
    is_two = np.zeros(len(pairs), bool)
    for a, b in ("re", "ve", "ll"):
        is_two |= (first == ord(a)) & (second == ord(b))
    for where, size in ((one, 2), (pairs[is_two], 3)):
        start[where + 1] = False
        after = where + size
        start[after[after < n]] = True


class Known:
    """What is known of distinct words: a list of numbers for each, kept from slice to slice.

    Words and numbers are flat arrays, so that some hundred thousand take tens of megabytes;
    beyond ``limit`` words it starts anew.
    """

    def __init__(self, seeds: dict[bytes, tuple[int, ...]], limit: int = 600_000):
        self.seeds, self.limit = seeds, limit
        self._reset()

    def _reset(self) -> None:
        self.words = pa.array([], pa.binary())
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self._append(pa.array(list(self.seeds), pa.binary()), list(self.seeds.values()))

    def _append(self, words: pa.Array, lists: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        more = np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(lengths))
        self.flat = np.append(self.flat, more)

    def index(self, words: pa.Array, learn: Callable[[list[bytes]], list[Sequence[int]]]) -> np.ndarray:
        """Where each of the distinct words stands; unknown ones go through ``learn`` first."""
        if len(self.words) + len(words) > self.limit:
            self._reset()
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            unknown = found.is_null()
            new = words.filter(unknown)
            base = len(self.words)
            self._append(new, learn(new.to_pylist()))
            where = found.fill_null(0).to_numpy().astype(np.int64)
            where[unknown.to_numpy(zero_copy_only=False)] = base + np.arange(len(new))
            return where
        return found.to_numpy().astype(np.int64)
