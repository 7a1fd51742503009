"""Many rules at a time: an automaton over texts that their matches contain picks the rules for a line."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.functions.factors import mandatory_factors
from gritline.functions.shapes import Charset, Shape, fixed_shapes

MARKS = 40  # conditions in one generated column

Factors = tuple[tuple[str, tuple[tuple[int, Shape | None], ...]], ...]


# The letters outside ASCII that match one of its letters without regard to case, and that letter.
_ASCII_KIN = ("\u0130\u0131\u017f\u212a", "iisk")


def folded(text: Column) -> Column:
    """Text in which a pattern's ASCII letters stand as such wherever it matches them without regard to case."""
    return F.lower(F.translate(text, *_ASCII_KIN))


def index_of(patterns: Sequence[str]) -> tuple[Factors, Factors, list[int]]:
    """Texts with the patterns (by place) that need one of them, as written and folded; patterns without any.

    Beside the place is the shape of which the text is a part, if the pattern is one of fixed shapes.
    """
    exact: dict[str, list[tuple[int, Shape | None]]] = {}
    loose: dict[str, list[tuple[int, Shape | None]]] = {}
    rest = []
    for place, pattern in enumerate(patterns):
        fold, texts = mandatory_factors(pattern)
        shapes = fixed_shapes(pattern)
        found = [(shape.text, shape) for shape in shapes] or [(text, None) for text in texts]
        for text, shape in found:
            (loose if fold else exact).setdefault(text, []).append((place, shape))
        if not found:
            rest.append(place)
    pack = lambda found: tuple((text, tuple(places)) for text, places in sorted(found.items()))
    return pack(exact), pack(loose), rest


_FEED = ord("\n")
_OTHERS = 128  # stands for all characters outside ASCII
_ENDS = np.array([_FEED, 0x0D, 0x85, 0x2028, 0x2029], np.uint32)  # where the end of a line may match before it


class _Index:
    """An automaton over texts, and for each of their patterns the sets of characters around them."""

    def __init__(self, factors: Factors):
        self.automaton = ahocorasick.Automaton()
        for k, (text, _) in enumerate(factors):
            self.automaton.add_word(text, k)
        self.automaton.make_automaton()
        entries = [(len(text), place, shape) for text, found in factors for place, shape in found]
        self.starts = np.cumsum([0, *(len(found) for _, found in factors)])
        self.lengths = np.array([size for size, _, _ in entries], np.int64)
        self.places = np.array([place for _, place, _ in entries], np.int64)
        self.shaped = np.array([shape is not None for _, _, shape in entries], bool)
        self.begins = np.array([shape is not None and shape.start for _, _, shape in entries], bool)
        self.ends = np.array([shape is not None and shape.end for _, _, shape in entries], bool)
        sets: dict[Charset, int] = {}
        self.before = self._around(sets, [shape.before if shape else () for _, _, shape in entries])
        self.after = self._around(sets, [shape.after if shape else () for _, _, shape in entries])
        self.sets = np.ones((len(sets) + 1, _OTHERS + 1), bool)  # the last one is no test at all
        for (found, negated), k in sets.items():
            self.sets[k] = negated
            self.sets[k, [ord(c) for c in found]] = not negated
            self.sets[k, _FEED] = False

    @staticmethod
    def _around(sets: dict[Charset, int], listed: list[tuple[Charset, ...]]) -> np.ndarray:
        out = np.full((len(listed), max(map(len, listed), default=0)), -1, np.int64)
        for row, found in enumerate(listed):
            for at, charset in enumerate(found):
                out[row, at] = sets.setdefault(charset, len(sets))
        return out

    def find(self, listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and whether the pattern matches for sure, for each text in each row that its surroundings don't rule out."""
        joined = "\n" + "\n".join(listed) + "\n"
        hits = list(self.automaton.iter(joined))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        stops, words = np.array(hits, np.int64).T
        stops = stops + 1
        counts = np.diff(self.starts)[words]
        entries = np.repeat(self.starts[words] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        stops = np.repeat(stops, counts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = stops - self.lengths[entries]
        for step in range(self.before.shape[1]):
            wanted = self.before[entries, step]
            keep = self._holds(codes, starts - 1, wanted)
            entries, stops, starts, wanted = entries[keep], stops[keep], starts[keep], wanted[keep]
            starts = starts - (wanted >= 0)
        for step in range(self.after.shape[1]):
            wanted = self.after[entries, step]
            keep = self._holds(codes, stops, wanted)
            entries, stops, starts, wanted = entries[keep], stops[keep], starts[keep], wanted[keep]
            stops = stops + (wanted >= 0)
        following = codes[np.minimum(stops, len(codes) - 1)]
        keep = (~self.begins[entries] | (codes[starts - 1] == _FEED)) & (~self.ends[entries] | np.isin(following, _ENDS))
        sure = self.shaped[entries] & (~self.ends[entries] | (following == _FEED))
        feeds = np.cumsum([len(t) + 1 for t in listed])
        return np.searchsorted(feeds, (starts - 1)[keep], "right"), self.places[entries[keep]], sure[keep]

    def _holds(self, codes: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        here = codes[np.clip(at, 0, len(codes) - 1)]
        return self.sets[wanted, np.minimum(here, _OTHERS)]


@functools.lru_cache(maxsize=4)
def _index(factors: Factors) -> _Index:
    """Built once per worker; its size is that of the rules."""
    return _Index(factors)


def candidates(patterns: Sequence[str], text: Column) -> tuple[Column, list[int]]:
    """Column of patterns that may match a line, and places of patterns that it doesn't speak of.

    Each is a ``place`` and ``fixed``, whether it matches for sure. Lines hold no line feed.
    """
    exact, loose, rest = index_of(patterns)

    @F.arrow_udf("array<struct<place:int,fixed:boolean>>")
    def pick(written: pa.Array, lower: pa.Array) -> pa.Array:
        found = [_index(f).find([t or "" for t in texts.to_pylist()]) for f, texts in ((exact, written), (loose, lower)) if f]
        rows, places, sure = (np.concatenate(columns) for columns in zip(*found))
        # Of a row and a pattern once, the sure one if there is any.
        order = np.lexsort((~sure, places, rows))
        rows, places, sure = rows[order], places[order], sure[order]
        once = np.append(True, (rows[1:] != rows[:-1]) | (places[1:] != places[:-1]))[: len(rows)]
        ends = np.append(0, np.cumsum(np.bincount(rows[once], minlength=len(written))))
        picked = pa.StructArray.from_arrays([pa.array(places[once], pa.int32()), pa.array(sure[once])], ["place", "fixed"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), picked)

    none = F.array().cast("array<struct<place:int,fixed:boolean>>")
    column = pick(text, folded(text) if loose else F.lit("")) if exact or loose else none
    return column, rest


def indexed_hits(
    lines: DataFrame, patterns: DataFrame, listed: Sequence[str], mark: Callable[[int], Column], matches: Column
) -> DataFrame:
    """The lines' columns, ``place`` of each pattern that matches and its row's columns, in one pass over the lines.

    ``listed`` are all patterns, and ``patterns`` has a row for each of them with ``place`` and what ``matches``, the
    condition of a line and such a row, needs. A line meets the patterns of which it holds a text, by a broadcast
    table of the rules' size; ``_fixed`` tells those that are known to match it, so that ``matches`` need not look again. For patterns
    without such a text, ``mark`` gives the place where they match, -1 elsewhere.
    """
    column, rest = candidates(listed, F.col("text"))
    marks = [mark(place) for place in rest]

    def named(places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("place"), F.lit(False).alias("fixed"), F.lit(True).alias("sure")))

    picked = F.transform(column, lambda p: F.struct(p["place"].alias("place"), p["fixed"].alias("fixed"), F.lit(False).alias("sure")))
    parts = [F.array(*marks[k : k + MARKS]).cast("array<int>") for k in range(0, len(marks), MARKS)]
    both = F.concat(picked, *[named(F.array_remove(part, -1)) for part in parts])
    met = lines.select("*", F.explode(both).alias("_met"))
    met = met.select(*lines.columns, *[F.col(f"_met.{c}").alias(n) for c, n in (("place", "place"), ("fixed", "_fixed"), ("sure", "_sure"))])
    joined = met.join(F.broadcast(patterns.withColumnRenamed("place", "_place")), F.col("place") == F.col("_place"))
    return joined.where(F.col("_sure") | matches).drop("_sure", "_fixed", "_place")
