"""Personal data: fixed patterns, and a skip-chain random field that extends them over a document."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritline.llm.batches import map_text, sliced, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
SAMPLE = 5000
TOLERANCE = 1e-6  # messages that change less are settled
ROUNDS = 10_000  # ends the messages of a document that would swing for ever
NEXT, SAME, SIMILAR = range(3)  # links of neighbours, of equal tokens, of tokens with the same digits

Span = tuple[int, int, int, bool]  # label, start, end, found by a pattern

# Each starts where the pattern asked for can start a leftmost match, and never goes back in a run.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARKED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_PLAIN = re.compile(r"[^0-9a-z]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts twice."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and then by start; offsets are code points."""
    out: list[Span] = []
    if "@" in text:
        out += [(1, a, b, True) for a, b in _emails(text)]
    if not _MARKED.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((2, *m.span(), True))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((3, *m.span(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((4, *m.span(), True))
    return out


def _shape(token: str) -> str:
    """A coarse shape, so that the table of shapes stays small."""
    digits = sum(c.isdigit() for c in token)
    marks = "".join(c for c in "@+.(-" if c in token)
    return f"{min(digits, 20)}{marks}{'a' if any(c.isalpha() for c in token) else ''}"


@dataclass
class Field:
    """Nodes (tokens with a digit or an at sign) and links of the documents of a slice."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    shape: list[str] = field(default_factory=list)
    given: list[int] = field(default_factory=list)
    links: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, doc: int, text: str, spans: Sequence[Span]) -> None:
        """Add a document. Equal tokens are linked to the next one, so that links are as many as tokens."""
        bounds = sorted((a, b, label) for label, a, b, _ in spans)
        at, latest = 0, {}
        before = -1
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            node = len(self.doc)
            while at < len(bounds) and bounds[at][1] <= a:
                at += 1
            inside = next((x[2] for x in bounds[at : at + len(KINDS)] if x[0] < b and x[1] > a), 0)
            self.doc.append(doc)
            self.start.append(a)
            self.end.append(b)
            self.shape.append(_shape(m.group()))
            self.given.append(inside)
            if before >= 0 and text[self.end[before] : a].isspace():
                self.links.append((before, node, NEXT))
            before = node
            plain = _PLAIN.sub("", m.group().lower())
            digits = "".join(c for c in plain if c.isdigit())
            for key, kind in (((SAME, plain), SAME), ((SIMILAR, digits), SIMILAR)):
                if len(key[1]) < 6:
                    continue
                other = latest.get(key)
                if other is not None and (kind == SAME or self.links[-1:] != [(other, node, SAME)]):
                    self.links.append((other, node, kind))
                latest[key] = node


@dataclass
class Model:
    """Log potentials: of labels by shape, and of pairs of labels by kind of link."""

    shapes: dict[str, np.ndarray]
    other: np.ndarray
    pairs: np.ndarray


def train(df: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Potentials from the labels that the patterns give in at most ``rows`` documents.

    Piecewise: a token's factor is the share of each label among tokens of its shape; a link's
    factor says how much more often two labels meet than by chance. Both are smoothed, so an
    empty table gives a model that adds nothing. The documents are the first in the order of a
    hash of the id, among those with a digit or an at sign; counts are made in the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            made = Field()
            for k, text in enumerate(part.column(1).to_pylist()):
                made.add(k, text, base_spans(text))
            keys = [f"{s} {y}" for s, y in zip(made.shape, made.given)]
            keys += [f"/{kind} {made.given[a]} {made.given[b]}" for a, b, kind in made.links]
            yield pa.record_batch([pa.array(keys, pa.string())], names=["key"])

    marked = df.where(F.col(text_col).rlike("[0-9@]"))
    ids = marked.select(F.col(id_col).cast("bigint").alias("id")).orderBy(F.xxhash64("id"), "id").limit(rows)
    picked = texts(marked, id_col, text_col).join(F.broadcast(ids.distinct()), "id", "left_semi")
    counts = {r["key"]: r["count"] for r in picked.mapInArrow(run, "key string").groupBy("key").count().collect()}
    by_shape: dict[str, np.ndarray] = {}
    totals = np.array([50.0, *[0.1] * len(KINDS)])
    pairs = np.zeros((3, LABELS, LABELS))
    for key, n in counts.items():
        parts = key.split(" ")
        if key[0] == "/":
            a, b = int(parts[1]), int(parts[2])
            pairs[int(parts[0][1:]), a, b] += n / 2
            pairs[int(parts[0][1:]), b, a] += n / 2
        else:
            by_shape.setdefault(parts[0], np.zeros(LABELS))[int(parts[1])] += n
            totals[int(parts[1])] += n
    chance = totals / totals.sum()
    meet = pairs + 5 * np.outer(chance, chance) + 2 * np.diag(chance) * np.array([1, 5, 5])[:, None, None]
    meet /= meet.sum(axis=(1, 2), keepdims=True)
    alone = meet.sum(axis=2)
    affinity = np.log(meet) - np.log(alone[:, :, None]) - np.log(alone[:, None, :])
    shapes = {s: np.log((c + chance) / (c + chance).sum()) for s, c in by_shape.items()}
    return Model(shapes, np.log(chance), np.clip(affinity, -6, 6))


def beliefs(model: Model, made: Field) -> np.ndarray:
    """Probability of each label at each node, by loopy sum-product messages; given labels are held."""
    n = len(made.doc)
    unary = np.array([model.shapes.get(s, model.other) for s in made.shape]).reshape(n, LABELS)
    given = np.array(made.given, np.int64)
    held = np.flatnonzero(given)
    unary[held] = -50.0
    unary[held, given[held]] = 0.0
    if made.links:
        link = np.array(made.links)
        # Both directions; the potentials are symmetric.
        source, target = np.append(link[:, 0], link[:, 1]), np.append(link[:, 1], link[:, 0])
        kind, half = np.append(link[:, 2], link[:, 2]), len(link)
        message = np.zeros((2 * half, LABELS))
        total = unary.copy()
        doc = np.array(made.doc)[source]
        live = np.arange(2 * half)  # messages of documents that still change; a document's end doesn't depend on others
        for _ in range(ROUNDS):
            there = np.where(live < half, live + half, live - half)
            out = (total[source[live]] - message[there])[:, :, None] + model.pairs[kind[live]]
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = 0.5 * (new - message[live])
            message[live] += step
            np.add.at(total, target[live], step)
            moving = np.zeros(int(doc.max()) + 1, bool)
            moving[doc[live[np.abs(step).max(axis=1) > TOLERANCE]]] = True
            live = live[moving[doc[live]]]
            if not len(live):
                break
    else:
        total = unary
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def find_spans(model: Model, contents: Sequence[str]) -> list[list[Span]]:
    """Spans of each text, by kind and then by start: those of the patterns and those added."""
    found = [base_spans(t) for t in contents]
    made = Field()
    for k, (text, spans) in enumerate(zip(contents, found)):
        if _MARKED.search(text):
            made.add(k, text, spans)
    if not made.doc:
        return found
    chance = beliefs(model, made)
    label = chance.argmax(axis=1)
    extra = np.flatnonzero((label > 0) & (chance.max(axis=1) > 0.5) & (np.array(made.given) == 0))
    together = {(a, b) for a, b, kind in made.links if kind == NEXT}
    open_spans: dict[int, Span] = {}
    for node in extra.tolist():
        doc, text = made.doc[node], contents[made.doc[node]]
        start, end = made.start[node], made.end[node]
        while not text[start].isalnum() and text[start] not in "+(":
            start += 1
        while not text[end - 1].isalnum():
            end -= 1
        last = open_spans.get(node - 1)
        if last and (node - 1, node) in together and last[0] == label[node]:
            found[doc].remove(last)
            start = last[1]
        span = (int(label[node]), start, end, False)
        found[doc].append(span)
        open_spans[node] = span
    for spans in found:
        spans.sort()
    return found


def personal_data(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end, base) of every row, by kind and then by start.

    Offsets are code points, the end is exclusive. ``base`` spans come from the patterns; the
    others are tokens to which the random field gives a label. A null or empty text has none,
    repeated rows stay, and other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": KINDS[y - 1], "start": a, "end": b, "base": base} for y, a, b, base in one]
            for one in find_spans(model, batch.column(1).to_pylist())
        ]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        return pa.record_batch([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    schema = f"{id_col} bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return map_text(df, work, schema, id_col, text_col)


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the first is named."""
    out, done = [], 0
    for start, end, label in sorted((a, b, y) for y, a, b, _ in spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[label - 1].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with personal data masked and the length column, if there is one, set anew.

    A null text stays null, and its length what it was. Rows are independent, so repeated rows are masked alike and stay; an empty
    table gives an empty one. Whole texts are masked, and further columns may have any names.
    """
    column = df.columns.index(text_col)
    sized = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column):
            old = part.column(column).to_pylist()
            spans = find_spans(model, [t or "" for t in old])
            new = [masked(t, s) if s else t for t, s in zip(old, spans)]
            columns = part.columns
            columns[column] = pa.array(new, pa.string())
            if sized is not None:
                sizes = [x if not s else len(t) for x, t, s in zip(part.column(sized).to_pylist(), new, spans)]
                columns[sized] = pa.array(sizes, part.column(sized).type)
            yield pa.record_batch(columns, names=part.schema.names)

    return df.mapInArrow(run, df.schema)
