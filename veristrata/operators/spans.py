"""Spans of claims in one text at a time, over its UTF-8 bytes: candidates of all patterns, numbers with their context, and the sweep that resolves overlaps.

Python's expressions over bytes know ASCII letters, digits and word boundaries only, and offsets are those of bytes, so
nothing has to be counted again. detect.py runs this in tasks, a batch of texts at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

# The claim patterns in their order of priority (category, pattern, subject group).
PATTERNS = [
    ("opinion", r"(?i)\bI\s+(prefer|believe|think|feel|value)\b", 0),
    ("tech_in_production", r"(?i)\b(production|shipped|live)\s+(Go|Python|TypeScript|JavaScript|Java|Ruby|Rust|C\+\+|C#|PHP|Swift|Kotlin|Scala|Elixir|Haskell)\b", 2),
    ("personal_action", r"(?i)\bI\s+(built|shipped|created|launched|wrote|designed|architected)\s+([A-Za-z0-9_+#\.\-/]+)", 2),
    ("quantitative", r"(?i)\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*(messages|users|customers|requests|MB|GB|TB|%)\b", 1),
    ("date", r"\b(\d{4}-\d{2}-\d{2}|(?:19|20)\d{2})\b", 1),
]
NUMBER = r"\b(\d+(?:,\d{3})*(?:\.\d+)?)\b"
# Prepositions before a bare year.
TEMPORAL = ("in", "since", "by", "during", "from", "until", "before", "after")

_COMPILED = [(k + 2, category, re.compile(pattern.encode()), group) for k, (category, pattern, group) in enumerate(PATTERNS)]
_NUMBER = re.compile(NUMBER.encode())
_BEFORE_YEAR = tuple(f"{word} ".encode() for word in TEMPORAL)
_WORD = re.compile(rb"\S+")
_DIGIT = re.compile(rb"[0-9]")


class Span(NamedTuple):
    """A candidate: its stage is its priority; forbidden ones are stage 0, contradicted ones 1, patterns follow."""

    start: int
    stage: int
    end: int
    category: str
    verdict: str
    text: str | None = None
    subject: str | None = None
    path: str | None = None


def candidates(raw: bytes) -> Iterator[Span]:
    """What the patterns find; a bare year after a temporal preposition is left out."""
    for stage, category, pattern, group in _COMPILED:
        for m in pattern.finditer(raw):
            start, end = m.span()
            if category == "date" and b"-" not in m[0] and raw[max(0, start - 8) : start].lower().endswith(_BEFORE_YEAR):
                continue
            yield Span(start, stage, end, category, "opinion" if category == "opinion" else "unverified", m[0].decode(), m[group].decode())


def resolve(spans: Iterable[Span]) -> list[Span]:
    """Greedy by stage, then place: a candidate goes if it overlaps one already taken; forbidden ones (stage 0) all stay.

    Spans come by start. The sweep closes a cluster where no open span reaches; in a cluster what is taken is kept as
    disjoint intervals by place, so each candidate is looked up, not compared with all.
    """
    out: list[Span] = []
    cluster: list[Span] = []
    reach = -1
    for x in spans:
        if x.start >= reach and cluster:
            out += _greedy(cluster)
            cluster = []
        cluster.append(x)
        reach = max(reach, x.end)
    return out + _greedy(cluster)


def _greedy(cluster: list[Span]) -> list[Span]:
    if len(cluster) == 1:
        return cluster
    taken: list[tuple[int, int]] = []
    out = []
    for x in sorted(cluster, key=lambda s: (s.stage, s.start)):
        at = bisect_left(taken, (x.end, -1))
        if x.stage and at and taken[at - 1][1] > x.start:
            continue
        out.append(x)
        start, end = x.start, x.end
        while at and taken[at - 1][1] > start:  # only forbidden spans overlap one another
            start, end = min(start, taken[at - 1][0]), max(end, taken[at - 1][1])
            del taken[at - 1]
            at -= 1
        insort(taken, (start, end))
    return sorted(out)


def numbers(raw: bytes) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, value, context) of each number that is no year: its context is the three words on either side, in lower case.

    Words are cut at white space; what is left of the number's own word, on a side, counts as one.
    """
    if not _DIGIT.search(raw):
        return
    words = [m.span() for m in _WORD.finditer(raw)]
    for i, (a, b) in enumerate(words):
        if not _DIGIT.search(raw, a, b):
            continue
        word = raw[a:b]
        for m in _NUMBER.finditer(word):
            value = float(m[1].replace(b",", b""))
            if 1900 <= value <= 2100 and value == int(value):
                continue
            left, right = word[: m.start()], word[m.end() :]
            before = [raw[s:e] for s, e in words[max(0, i - 3) : i]] + ([left] if left else [])
            after = ([right] if right else []) + [raw[s:e] for s, e in words[i + 1 : i + 4]]
            context = b" ".join(before[-3:] + after[:3]).decode("utf-8", "replace").lower()
            yield a + m.start(), a + m.end(), value, context


def grams(context: str) -> list[str]:
    """The distinct runs of three bytes of a text, a character a byte."""
    view = context.encode().decode("latin-1")
    return sorted({view[i : i + 3] for i in range(len(view) - 2)})
