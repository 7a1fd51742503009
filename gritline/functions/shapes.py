"""Patterns that match texts of fixed shapes only, which can be told by looking at each character once."""

from __future__ import annotations

import string
from typing import NamedTuple

from gritline.functions.factors import LEAST

MOST = 64  # shapes of one pattern, and characters of one shape
_BREAKS = frozenset("\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")
_ESCAPED = frozenset(string.punctuation)
_ALNUM = frozenset(string.ascii_letters + string.digits)

Charset = tuple[frozenset[str], bool]  # characters, and whether all others are meant instead


class Shape(NamedTuple):
    """A text with the sets of the characters before and after it, and whether these begin and end the line."""

    text: str
    before: tuple[Charset, ...]
    after: tuple[Charset, ...]
    start: bool
    end: bool


class _Unknown(Exception):
    """Not of fixed shapes, or a construct that this reader doesn't know."""


class _Reader:
    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self, size: int = 1) -> str:
        return self.text[self.at : self.at + size]

    def take(self) -> str:
        out = self.peek()
        if not out:
            raise _Unknown
        self.at += 1
        return out

    def escaped(self) -> str:
        c = self.take()
        if c not in _ESCAPED:
            raise _Unknown
        return c

    def char_class(self) -> Charset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[str] = set()
        while (c := self.take()) != "]" or not found:
            if c == "\\":
                c = self.escaped()
            elif c in "[]^-&" or not c.isascii() or c in _BREAKS:
                raise _Unknown
            if self.peek() == "-":
                self.take()
                last = self.take()
                if not {c, last} <= _ALNUM or c > last:
                    raise _Unknown
                found |= {chr(k) for k in range(ord(c), ord(last) + 1)}
            else:
                found.add(c)
        if self.fold:
            # A set that lists a letter in one case only does not treat all letters that are alike to it alike.
            if any(c.swapcase() not in found for c in found):
                raise _Unknown
            found = {c.lower() for c in found}
        return frozenset(found), negated

    def literal(self, c: str) -> Charset:
        if c in _BREAKS or self.fold and not c.isascii():
            raise _Unknown
        return frozenset([c.lower() if self.fold else c]), False

    def alternatives(self) -> list[tuple]:
        out = self.branch()
        while self.peek() == "|":
            self.take()
            out += self.branch()
        return out

    def branch(self) -> list[tuple]:
        out: list[tuple] = [()]
        while (c := self.peek()) and c not in "|)":
            self.take()
            if c == "(":
                if self.peek() == "?" and self.peek(2) != "?:":
                    raise _Unknown
                self.at += 2 if self.peek() == "?" else 0
                parts = self.alternatives()
                if self.take() != ")":
                    raise _Unknown
            elif c == "[":
                parts = [(self.char_class(),)]
            elif c == "\\":
                parts = [(self.literal(self.escaped()),)]
            elif c in ".*+?{":
                raise _Unknown
            else:
                parts = [(c if c in "^$" else self.literal(c),)]
            if self.peek() and self.peek() in "*+?{":
                raise _Unknown
            out = [a + b for a in out for b in parts]
            if len(out) > MOST or max(map(len, out)) > MOST:
                raise _Unknown
        return out


def _shape(parts: tuple) -> Shape:
    start, end = parts[:1] == ("^",), parts[-1:] == ("$",)
    sets = parts[start : len(parts) - end]
    if "^" in sets or "$" in sets:
        raise _Unknown
    singles = "".join(next(iter(found)) if len(found) == 1 and not negated else "\n" for found, negated in sets)
    text = max(singles.split("\n"), key=len)
    if len(text) < LEAST:
        raise _Unknown
    at = singles.index(text)
    before, after = sets[:at][::-1], sets[at + len(text) :]
    if not all(c.isascii() for found, _ in before + after for c in found):
        raise _Unknown
    return Shape(text, before, after, start, end)


def fixed_shapes(pattern: str) -> list[Shape]:
    """The shapes of which a line holds one wherever the pattern matches, and nowhere else; none if that isn't known.

    ``before`` goes from the text to the left. Sets list ASCII characters only. For patterns that fold case, sets and texts are ASCII
    in lower case and are to be looked for in :func:`gritline.operators.rule_index.folded` text. Where a shape ends the line, Java
    also lets it end before a last line break.
    """
    fold = pattern.startswith("(?i)")
    reader = _Reader(pattern[4:] if fold else pattern, fold)
    try:
        found = [_shape(parts) for parts in reader.alternatives()]
    except _Unknown:
        return []
    return found if reader.at == len(reader.text) else []
