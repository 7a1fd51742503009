"""Read the vocabulary and merges of a public tokenizer file."""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from dataclasses import dataclass

NO_PARENT = 1 << 60
GONE = -1


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as letter -> byte.

    Printable bytes of Latin-1 stand for themselves, the others for letters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tokens as bytes. ``middle`` and ``final``: id by bytes, inside a word and at its end.

    Without an end-of-word suffix the two are one dictionary. ``halves`` has the two parts of
    a merged token, ``merged`` the rank and the token of a pair.
    """

    middle: dict[bytes, int]
    final: dict[bytes, int]
    strings: list[str]
    halves: dict[int, tuple[int, int]]
    merged: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    longest: int
    glue_blank: bool
    lowers: bool
    joins_bytes: bool

    def symbols(self, word: bytes, ends: bool = True) -> list[int]:
        """Ids of the single bytes of a word; the last one is a word end if ``ends``."""
        ids = [self.middle[word[k : k + 1]] for k in range(len(word))]
        if word and ends:
            ids[-1] = self.final[word[-1:]]
        return ids

    def merge(self, word: bytes, ends: bool = True) -> tuple[int, ...]:
        """Plain byte-pair merging: always the earliest merge, the leftmost one on ties.

        Tokens are a linked list and possible merges a heap, so a word of n bytes takes n log n steps.
        """
        ids = self.symbols(word, ends)
        n, merged = len(ids), self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k) for k, pair in enumerate(zip(ids, ids[1:])) if (found := merged.get(pair))]
        heapq.heapify(heap)
        while heap:
            rank, left = heapq.heappop(heap)
            right = after[left] if ids[left] >= 0 else n
            found = merged.get((ids[left], ids[right])) if right < n else None
            if not found or found[0] != rank:
                continue  # one of the two went into another token since
            ids[left], ids[right] = found[1], GONE
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
            for k in (before[left], left):
                if k >= 0 and after[k] < n and (found := merged.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (found[0], k))
        return tuple(i for i in ids if i >= 0)


def read(path: str) -> bytes:
    """The file, small enough (a few MB) to travel with each task."""
    with open(path, "rb") as file:
        return zlib.compress(file.read(), 6)


@functools.lru_cache(maxsize=4)
def load(packed: bytes) -> Vocabulary:
    """Build the tables, once per process."""
    spec = json.loads(zlib.decompress(packed))
    model = spec["model"]
    suffix = model.get("end_of_word_suffix") or ""
    letters = byte_letters()
    ids: dict[str, int] = model["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    middle: dict[bytes, int] = {}
    final: dict[bytes, int] = {}
    for text, number in ids.items():
        if text in specials:
            continue
        ends = bool(suffix) and text.endswith(suffix)
        body = text[: -len(suffix)] if ends else text
        if all(c in letters for c in body):
            (final if ends else middle)[bytes(letters[c] for c in body)] = number
    if not suffix:
        final = middle
    merged: dict[tuple[int, int], tuple[int, int]] = {}
    halves: dict[int, tuple[int, int]] = {}
    rank_of: dict[int, int] = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = (ids[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
        token = ids["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")]
        if max(rank_of.get(left, -1), rank_of.get(right, -1)) >= rank or token in halves:
            raise ValueError("merges are not in the order in which their parts arise")
        merged[left, right] = rank, token
        halves[token] = left, right
        rank_of[token] = rank
    strings = [""] * (1 + max([*ids.values(), *specials.values()]))
    for text, number in [*ids.items(), *specials.items()]:
        strings[number] = text
    longest = max(map(len, [*middle, *final]))
    return Vocabulary(
        middle, final, strings, halves, merged, specials, longest,
        glue_blank=spec["pre_tokenizer"]["type"] == "ByteLevel",
        lowers=spec["normalizer"] is not None,
        joins_bytes=spec["decoder"] is not None,
    )
