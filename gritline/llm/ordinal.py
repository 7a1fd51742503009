"""Cumulative-link ordinal regression on hashed text features."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritline.llm.batches import gather, list_array, map_text, offsets_of, sliced, texts
from gritline.llm.pretokens import Known, pretokens, segments

BUCKETS = 1 << 20
SAMPLE = 3000
MARKS = 4
REPEATED = BUCKETS - 1  # stands for a pair of tokens that its text had before


def _features(words: list[bytes]) -> list[tuple[int, int]]:
    """Two buckets of each pre-token: the lower-cased token, and its shape (case, kind and length)."""
    out = []
    for word in words:
        text = word.decode()
        if text.isupper():
            shape = "upper" if len(text) > 1 else "initial"
        elif text.istitle():
            shape = "title"
        elif text.isalpha():
            shape = "lower"
        else:
            shape = "number" if text.isnumeric() else "mark"
        out.append(
            (
                xxhash.xxh32_intdigest(text.lower().encode(), 1) % REPEATED,
                xxhash.xxh32_intdigest(f"{shape} {min(len(text), 12)}".encode(), 2) % REPEATED,
            )
        )
    return out


@functools.lru_cache(maxsize=1)
def _known() -> Known:
    return Known({})


def token_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts, the text of each bucket, and the number of pre-tokens of each text."""
    parts, owner, special = segments(texts, ())
    pieces = pretokens(parts, special, glue_blank=False)
    if not len(pieces.codes):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    known = _known()
    places = known.index(pieces.words, _features)[pieces.codes]
    buckets, ends = gather(places, known.starts, known.flat)
    text = owner[pieces.segment]
    # A third feature: whether the token and the one before it came together earlier in the text.
    pairs = np.stack([text[1:], places[:-1], places[1:]], axis=1)[text[1:] == text[:-1]]
    order = np.lexsort(pairs.T)
    again = (pairs[order[1:]] == pairs[order[:-1]]).all(axis=1)
    seen = np.bincount(pairs[order[1:]][again, 0], minlength=len(texts))
    tokens = np.bincount(text, minlength=len(texts))
    repeats = np.repeat(np.arange(len(texts)), seen)
    buckets = np.concatenate([buckets, np.full(len(repeats), REPEATED, buckets.dtype)])
    return buckets, np.concatenate([np.repeat(text, np.diff(ends)), repeats]), tokens


@dataclass
class Model:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]); x are counts over tokens ** power."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    power: float

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))

    def score(self, texts: Sequence[str]) -> np.ndarray:
        dense = _dense(self)
        buckets, text, tokens = token_features(texts)
        return np.bincount(text, dense[buckets], len(texts)) / np.maximum(tokens, 1) ** self.power


_dense_of: dict[int, tuple[Model, np.ndarray]] = {}


def _dense(model: Model) -> np.ndarray:
    found = _dense_of.get(id(model))
    if found is None or found[0] is not model:
        _dense_of.clear()
        dense = np.zeros(BUCKETS, np.float32)
        dense[model.buckets] = model.weights
        found = _dense_of[id(model)] = model, dense
    return found[1]


def _loss(
    parameters: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
    weight: np.ndarray, n_grades: int, ridge: float,
) -> tuple[float, np.ndarray]:
    """Penalised negative log likelihood and its gradient; parameters are weights, a threshold and log gaps."""
    n, d = len(grades), len(parameters) - n_grades + 1
    w, gap = parameters[:d], np.exp(parameters[d + 1 :])
    bounds = np.concatenate([[-np.inf], parameters[d] + np.append(0, np.cumsum(gap)), [np.inf]])
    score = np.bincount(rows, values * w[columns], n)
    with np.errstate(over="ignore"):
        low = 1 / (1 + np.exp(bounds[grades] - score))  # P(at least this grade)
        high = 1 / (1 + np.exp(bounds[grades + 1] - score))  # P(above it)
    chance = np.maximum(low - high, 1e-12)
    slope_low, slope_high = low * (1 - low) / chance * weight, high * (1 - high) / chance * weight
    by_score = slope_high - slope_low
    by_bound = np.bincount(grades, slope_low, n_grades + 1) - np.bincount(grades + 1, slope_high, n_grades + 1)
    by_threshold = by_bound[1:n_grades]
    gradient = np.concatenate(
        [
            np.bincount(columns, values * by_score[rows], d) + ridge * w,
            [by_threshold.sum()],
            np.cumsum(by_threshold[::-1])[::-1][1:] * gap,
        ]
    )
    return float(-(weight * np.log(chance)).sum() + ridge / 2 * (w @ w)), gradient


def fit(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, share: np.ndarray,
    n_grades: int, steps: int = 100, ridge: float = 1e-4, memory: int = 8,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the largest penalised likelihood, by limited-memory BFGS.

    ``share`` weighs the rows. Thresholds are the first one and positive gaps, so they stay ordered
    while all of them share the weights.
    """
    d, weight = int(columns.max(initial=-1)) + 1, share / share.sum()
    above = np.clip([weight[grades > k].sum() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log((1 - above) / above)
    now = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    loss, slope = _loss(now, rows, columns, values, grades, weight, n_grades, ridge)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        step, kept = -slope, []
        for moved, turned in reversed(moves):
            part = (moved @ step) / (turned @ moved)
            kept.append(part)
            step = step - part * turned
        if moves:
            moved, turned = moves[-1]
            step = step * ((moved @ turned) / (turned @ turned))
        for (moved, turned), part in zip(moves, reversed(kept)):
            step = step + (part - (turned @ step) / (turned @ moved)) * moved
        descent, pace = float(slope @ step), 1.0 if moves else min(1.0, 1 / np.abs(slope).sum())
        while pace > 1e-8:
            then = now + pace * step
            new_loss, new_slope = _loss(then, rows, columns, values, grades, weight, n_grades, ridge)
            if new_loss <= loss + 1e-4 * pace * descent:
                break
            pace /= 2
        else:
            break
        moved, turned, fell = then - now, new_slope - slope, loss - new_loss
        now, loss, slope = then, new_loss, new_slope
        if moved @ turned > 1e-12:
            moves = [*moves[1 - memory :], (moved, turned)]
        if fell < 1e-7 * max(1.0, abs(loss)):
            break
    return now[:d], now[d] + np.append(0, np.cumsum(np.exp(now[d + 1 :])))


@dataclass
class Sample:
    """Sparse rows of a bounded sample: tokens and bucket counts, grade and weight of each row."""

    rows: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    grades: np.ndarray
    share: np.ndarray


def sample(df: DataFrame, graded: DataFrame, per_grade: int, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """Features of at most ``per_grade`` rows of each grade, the first in the order of a hash of the id.

    ``graded`` has ``id`` and ``grade``; null grades and ids without a document are left out. All
    grades weigh the same, however many rows they have.
    """
    present = [r["grade"] for r in graded.where("grade IS NOT NULL").select("grade").distinct().collect()]
    chosen = [
        graded.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(per_grade) for g in sorted(present)
    ]
    empty = np.zeros(0, np.int64)
    if not chosen:
        return Sample(empty, empty, empty, empty, empty, empty.astype(float))
    ids = functools.reduce(DataFrame.union, chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            buckets, text, tokens = token_features(part.column(1).to_pylist())
            keys, counts = np.unique(text * BUCKETS + buckets, return_counts=True)
            ends = offsets_of(np.bincount(keys // BUCKETS, minlength=part.num_rows))
            columns = [
                list_array(ends, (keys % BUCKETS).astype(np.int32)),
                list_array(ends, counts.astype(np.int32)),
                pa.array(tokens),
                part.column(2),
            ]
            yield pa.record_batch(columns, names=["buckets", "counts", "tokens", "grade"])

    # At most per_grade rows for each grade, an id and a number each: small by construction.
    picked = texts(df, id_col, text_col).join(F.broadcast(ids.select("id", F.col("grade").cast("int"))), "id")
    found = picked.mapInArrow(run, "buckets array<int>, counts array<int>, tokens bigint, grade int").toArrow()
    lists = found["buckets"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    grades = found["grade"].to_numpy().astype(np.int64)
    return Sample(
        np.repeat(np.arange(len(lengths)), lengths),
        lists.flatten().to_numpy().astype(np.int64),
        found["counts"].combine_chunks().flatten().to_numpy().astype(np.float64),
        found["tokens"].to_numpy(),
        grades,
        1 / np.maximum(np.bincount(grades), 1)[grades],
    )


def telling_buckets(data: Sample, n_grades: int, errors: float) -> np.ndarray:
    """Buckets whose share of rows differs between the grades above and below some threshold."""
    found = np.bincount(data.columns, minlength=BUCKETS)
    chosen = np.zeros(BUCKETS, bool)
    for k in range(n_grades - 1):
        above = data.grades > k
        n, m = len(above), int(above.sum())
        if 0 < m < n:
            with_it = np.bincount(data.columns[above[data.rows]], minlength=BUCKETS)
            spread = found / n * (1 - found / n) * (1 / m + 1 / (n - m)) + 1e-12
            chosen |= np.abs(with_it / m - (found - with_it) / (n - m)) >= errors * np.sqrt(spread)
    # A bucket in every row, such as a shape, may still differ in how often it comes.
    return chosen | (found > 0.5 * len(data.grades))


def train(
    data: Sample, n_grades: int, power: float, telling: float, ridge: float = 1e-3, among: np.ndarray | None = None
) -> Model:
    """Fit a model on a sample; only buckets that tell grades apart have a weight.

    A bucket does if, for some threshold, its share among the rows above and its share among the
    others are at least ``telling`` standard errors apart. Most words of a corpus are rare and say
    nothing; with a weight for each, the fit would learn its sample by heart. ``among`` gives the
    buckets instead.

    If the sample has a single grade, the model gives that grade to all rows; if it is empty, the
    highest one.
    """
    empty = np.zeros(0, np.int64)
    if len(np.unique(data.grades)) < 2:
        only = int(data.grades[0]) if len(data.grades) else n_grades - 1
        sure = np.array([-40.0 if k < only else 40.0 for k in range(n_grades - 1)])
        return Model(empty, empty.astype(np.float32), sure, power)
    chosen = telling_buckets(data, n_grades, telling)
    if among is not None:
        chosen[:] = False
        chosen[among] = True
    keep = chosen[data.columns]
    used, columns = np.unique(data.columns[keep], return_inverse=True)
    rows = data.rows[keep]
    values = data.counts[keep] / np.maximum(data.tokens[rows], 1) ** power
    scale = np.sqrt(np.bincount(columns, values**2) / len(data.grades))  # so that one penalty suits all buckets
    weights, thresholds = fit(rows, columns, values / scale[columns], data.grades, data.share, n_grades, ridge=ridge)
    return Model(used, (weights / scale).astype(np.float32), thresholds, power)


def marked_tokens(data: Sample, chosen: np.ndarray) -> np.ndarray:
    """How many of each row's features are in ``chosen`` buckets that ``MARKS`` times the share of rows above grade 0 have."""
    above = data.grades > 0
    n, m = len(above), max(1, int(above.sum()))
    found = np.bincount(data.columns, minlength=BUCKETS)
    with_it = np.bincount(data.columns[above[data.rows]], minlength=BUCKETS)
    marking = chosen & (with_it / m > MARKS * (found - with_it) / max(1, n - m))
    return np.bincount(data.rows, data.counts * marking[data.columns], n)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``tails``, P(grade > k) for k from 0, of every row and whole text."""
    n = len(model.thresholds)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tails = model.tails(model.score(batch.column(1).to_pylist()))
        lists = list_array(np.arange(batch.num_rows + 1) * n, tails.ravel())
        return pa.record_batch([batch.column(0), lists], names=[id_col, "tails"])

    return map_text(df, work, f"{id_col} bigint, tails array<double>", id_col, text_col)


def keep_rows(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose P(grade > 0) is at least ``least``.

    A null text is scored as an empty one and stays null. Rows are independent: repeated rows and ids stay or go each, an empty
    table gives an empty one, whole texts are scored, and columns may have any names.
    """
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            tails = model.tails(model.score([t or "" for t in part.column(column).to_pylist()]))
            yield part.filter(pa.array(tails[:, 0] >= least))

    return df.mapInArrow(run, df.schema)


def expected(tails: Column) -> Column:
    """The mean grade is the sum of the tail probabilities."""
    return F.aggregate(tails, F.lit(0.0), lambda a, b: a + b)
