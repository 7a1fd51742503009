"""Texts that every match of a pattern contains."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

LEAST = 3  # shorter texts are too common to be worth an entry
MOST = 64  # texts for one pattern
_NO_LITERAL = frozenset(string.ascii_letters + string.digits)
_ASIDE = ("?=", "?!", "?<=", "?<!")  # look around: no text of the match
_BREAKS = frozenset("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ")


class _Unknown(Exception):
    """A construct that this reader doesn't know."""


@dataclass
class _Branch:
    """One alternative: the best set of texts so far, and the text being read."""

    best: list[str] | None = None
    run: list[str] = field(default_factory=list)

    def offer(self, texts: list[str] | None) -> None:
        if texts and len(texts) <= MOST and (self.best is None or _worth(texts) > _worth(self.best)):
            self.best = texts

    def close(self) -> None:
        if len(self.run) >= LEAST:
            self.offer(["".join(self.run)])
        self.run = []


def _worth(texts: list[str]) -> tuple[int, int]:
    return min(map(len, texts)), -len(texts)


class _Reader:
    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self, size: int = 1) -> str:
        return self.text[self.at : self.at + size]

    def take(self, size: int = 1) -> str:
        out = self.peek(size)
        if len(out) < size:
            raise _Unknown
        self.at += size
        return out

    def until(self, end: str) -> None:
        found = self.text.find(end, self.at)
        if found < 0:
            raise _Unknown
        self.at = found + 1

    def least_times(self) -> tuple[int, bool]:
        """How often the atom before comes at least, and whether that is just once and no more."""
        sign, least = self.peek(), 1
        if sign not in ("*", "+", "?", "{") or not sign:
            return 1, True
        self.take()
        if sign in "*?":
            least = 0
        elif sign == "{":
            digits = ""
            while self.peek().isdigit():
                digits += self.take()
            if not digits:
                raise _Unknown
            least = int(digits)
            self.until("}")
        if self.peek() in ("?", "+") and self.peek():
            self.take()
        return least, False

    def char_class(self) -> None:
        if self.peek() == "^":
            self.take()
        first, depth = True, 1
        while depth:
            c = self.take()
            if c == "\\":
                self.escape()
            elif c == "[" and self.peek() == ":":
                self.until("]")
            elif c == "[":
                depth += 1
            elif c == "]" and not first:
                depth -= 1
            elif c == "&" and self.peek() == "&":
                raise _Unknown
            first = False

    def escape(self) -> str | None:
        """The character that an escape stands for, if it is a plain one."""
        c = self.take()
        if c not in _NO_LITERAL:
            return c
        if c in "QEkgcN0123456789":
            raise _Unknown
        if c in "pP" and self.peek() != "{":
            self.take()
        elif c in "pPx" and self.peek() == "{":
            self.until("}")
        elif c in "xu":
            self.take(2 if c == "x" else 4)
        return "\t" if c == "t" else None

    def group(self) -> list[str] | None:
        """Texts of a group, of which one is in what it matches."""
        aside = False
        if self.peek() == "?":
            aside = any(self.peek(len(sign)) == sign for sign in _ASIDE)
            if aside:
                self.take(3 if self.peek(2) == "?<" else 2)
            elif self.peek(2) in ("?:", "?>"):
                self.take(2)
            elif self.peek(2) == "?<" or self.peek(3) == "?P<":
                self.until(">")
            else:
                raise _Unknown
        texts = self.alternatives()
        if self.take() != ")":
            raise _Unknown
        return None if aside else texts

    def alternatives(self) -> list[str] | None:
        branches = [self.branch()]
        while self.peek() == "|":
            self.take()
            branches.append(self.branch())
        if not all(branches):
            return None
        return sorted({text for texts in branches for text in texts or ()})

    def branch(self) -> list[str] | None:
        out = _Branch()
        while (c := self.peek()) and c not in "|)":
            self.take()
            literal: str | None = None
            texts: list[str] | None = None
            if c == "(":
                texts = self.group()
            elif c == "[":
                self.char_class()
            elif c == "\\":
                literal = self.escape()
            elif c in "*+?{":
                raise _Unknown
            elif c not in ".^$":
                literal = c
            least, once = self.least_times()
            if literal is None or literal in _BREAKS or (self.fold and not literal.isascii()):
                out.close()
                if least:
                    out.offer(texts)
                continue
            if least:
                out.run.append(literal.lower() if self.fold else literal)
            if not once:
                out.close()
        out.close()
        return out.best


def mandatory_factors(pattern: str) -> tuple[bool, list[str]]:
    """Whether a pattern folds case, and texts of which every match within a line contains one.

    Of the texts between groups, classes and repeats, and those of groups that must match, it is the
    set whose shortest one is longest. No texts means that none are known: the pattern has none of ``LEAST``
    characters, or this reader doesn't know a construct in it. For patterns that fold case, the texts are ASCII in
    lower case and are to be looked for in :func:`gritline.operators.rule_index.folded` text.
    """
    fold = pattern.startswith("(?i)")
    reader = _Reader(pattern[4:] if fold else pattern, fold)
    try:
        texts = reader.alternatives()
    except _Unknown:
        return fold, []
    return fold, texts if texts and reader.at == len(reader.text) else []
