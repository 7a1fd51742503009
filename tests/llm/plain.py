"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def words(text: str) -> list[bytes]:
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))


def fingerprint(text: str, size: int = 4) -> int:
    found = words(text)
    runs = [found[k : k + size] for k in range(len(found) - size + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def smallest_reachable(links: list[tuple], nodes: list) -> dict:
    around = defaultdict(set)
    for a, b in links:
        around[a].add(b)
        around[b].add(a)
    root: dict = {}
    for node in sorted(nodes):
        todo = [] if node in root else [node]
        while todo:
            at = todo.pop()
            if at not in root:
                root[at] = node
                todo += around[at]
    return root


def passages(texts: dict[int, str], least: int) -> set[tuple]:
    found = {k: words(t) for k, t in texts.items()}
    where = defaultdict(set)
    for k, w in found.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(k)
    out = set()
    for k, w in found.items():
        spans: list[list] = []
        for i in range(len(w) - least + 1):
            ids = where[tuple(w[i : i + least])]
            if len(ids) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1:] = [i + least, min(spans[-1][2], *ids), spans[-1][3] and min(ids) == k]
                else:
                    spans.append([i, i + least, min(ids), min(ids) == k])
        for n, (a, b, first, is_first) in enumerate(spans, 1):
            out.add((k, n, a, b - a, first, is_first))
    return out


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 8 <= len(digits) <= 15)
            ):
                out.append((kind, *m.span()))
    return out
