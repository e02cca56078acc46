"""Personal data: weak labelers vote on spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Base kinds in their order; added kinds follow.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("key", "secret", "number")
ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}

# Look-behinds and possessive repeats keep the searches linear; they match what the plain patterns match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Tokens that may hold personal data or secrets beside the base kinds: with a digit, or after a cue and an equals sign or colon.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]*[0-9][A-Za-z0-9_+/.-]*")
_BARE = r"[A-Za-z0-9_+/.-]+"
_EDGE = "._+/-"
#: A number that starts like a phone's, where the base pattern ran on into what follows it.
_DIAL = re.compile(r"\+[0-9](?:[ ().-]{0,2}[0-9]){9,14}(?![0-9])")

#: Gazetteers (fixed values): words of credentials and contacts, and words about versions, licences and counting.
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "key", "iban", "ssn", "passport", "account", "mail", "tel", "phone", "call", "card")
HARMLESS = ("version", "licensed", "license", "copyright", "page", "chapter", "section", "figure", "table", "cc", "by", "gnu", "apache", "mit", "no.", "vol.")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "xoxb-", "xoxp-", "AIza", "glpat-")

_CUE = re.compile(r"(?i)(?:^|[^a-z])(?:" + "|".join(map(re.escape, CUES)) + r")[\"']?\s*[=:]?\s*[\"']?$")
#: A value after a cue and an equals sign or colon, with or without a digit.
_GIVEN = re.compile(r"(?i)(?<![a-z])(?:" + "|".join(map(re.escape, CUES)) + r")[\"']?\s*+[=:]\s*+[\"']?(" + _BARE + ")")
_ASSIGN = re.compile(r"[=:]\s*[\"']?$")
_HARMLESS = re.compile(r"(?i)(?:^|[^a-z])(?:" + "|".join(map(re.escape, HARMLESS)) + r")[^a-z0-9]{0,4}(?:[A-Za-z-]{1,6}[^a-z0-9]{1,2})?$")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_KEYLIKE = re.compile(r"[A-Z0-9]{16,}")
_LETTER = re.compile(r"[A-Za-z]")
_PLAIN = re.compile(r"[0-9]{1,4}(?:[.,/-][0-9]{1,4}){0,2}")
LABELERS = ("regex", "shape", "gazetteer", "context", "plain")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost, non-overlapping within a kind; failing matches are dropped."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m and at >= end:
            s = at
            while s > end and _LOCAL.match(text, s - 1):
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def votes(text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 personal, -1 harmless, 0 abstains."""
    x = text[start:end]
    before = text[max(0, start - 32) : start]
    regex = 1 if base or x.startswith(KEY_PREFIXES) or _DIAL.fullmatch(x) else 0
    shape = 1 if _HEX.fullmatch(x) or _KEYLIKE.fullmatch(x) else -1 if len(x) < 8 else 0
    cue, assigned = bool(_CUE.search(before)), bool(_ASSIGN.search(before))
    gazetteer = 1 if cue else -1 if _HARMLESS.search(before) else 0
    context = 1 if cue and assigned or base else -1 if not assigned and len(x) < 8 else 0
    plain = -1 if _PLAIN.fullmatch(x) else 1 if len(x) >= 14 else 0
    return regex, shape, gazetteer, context, plain


def traits(text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse span features of the final classifier, each of few values: length, digit share, cases, marks."""
    x = text[start:end]
    digits = sum("0" <= c <= "9" for c in x)
    return (
        min(4, int(math.log2(len(x)))) if x else 0,
        min(3, 4 * digits // max(1, len(x))),
        int(any("A" <= c <= "Z" for c in x)),
        int(any("a" <= c <= "z" for c in x)),
        int(any(c in "._+/-@" for c in x)),
        int(text[max(0, start - 1) : start] in ("=", '"', "'", ":")),
    )


def candidates(text: str | None) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base?, votes and traits) of all base spans and of further tokens that do not lie within them."""
    if not text:
        return []
    base = base_spans(text) if _ANY.search(text) else []
    out = [(k, s, e, True, votes(text, s, e, True) + traits(text, s, e)) for k, s, e in base]
    taken = _Cover([(s, e) for _, s, e in base])
    dialled = [m.span() for m in _DIAL.finditer(text) if not taken.holds(*m.span())] if "+" in text else []
    out += [("number", s, e, False, votes(text, s, e, False) + traits(text, s, e)) for s, e in dialled]
    taken = _Cover([(s, e) for _, s, e in base] + dialled)
    given = [m.span(1) for m in _GIVEN.finditer(text) if not _DIGIT.search(m[1])] if "=" in text or ":" in text else []
    tokens = [m.span() for m in _TOKEN.finditer(text)] if _DIGIT.search(text) else []
    for s, e in [*tokens, *given]:
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        if s < e and not taken.holds(s, e):
            x = text[s:e]
            kind = "key" if x.startswith(KEY_PREFIXES) or _KEYLIKE.fullmatch(x) and not x.isdigit() else "number" if not _LETTER.search(x) else "secret"
            out.append((kind, s, e, False, votes(text, s, e, False) + traits(text, s, e)))
    return out


class _Cover:
    """Which spans lie within what earlier-starting spans reach."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach, far = [s for s, _ in spans], [], 0
        for _, e in spans:
            far = max(far, e)
            self.reach.append(far)

    def holds(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return k > 0 and self.reach[k - 1] >= end


# ---------------------------------------------------------------- model


def patterns(docs: DataFrame, text: str = "text") -> dict[tuple[int, ...], int]:
    """How often each pattern of votes and traits occurs, over all candidates of all texts.

    There are at most 3^5 * 5 * 4 * 2^4 patterns, whatever the corpus: counts are summed per batch, then by key.
    """

    def run(batches):
        for b in batches:
            seen = Counter(c[4] for t in b.column(0).to_pylist() for c in candidates(t))
            yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, p)) for p in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])

    rows = map_batches(docs.select(F.col(text)), run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {tuple(map(int, r[0].split(","))): r[1] for r in rows}


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Prior of "personal" and P(vote | class) [labelers, 2, 3], by expectation-maximisation over vote patterns."""
    k = len(LABELERS)
    merged: Counter = Counter()
    for p, n in counts.items():
        merged[p[:k]] += n
    v = np.array(sorted(merged), dtype=int).reshape(-1, k)
    n = np.array([merged[tuple(x)] for x in v], dtype=float)
    post = 1 / (1 + np.exp(-2.0 * v.sum(axis=1)))
    prior, table = 0.5, np.full((k, 2, 3), 1 / 3)
    for _ in range(rounds):
        prior = float(np.clip((n * post).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3))
        for j in range(k):
            for c, w in ((1, n * post), (0, n * (1 - post))):
                mass = np.bincount(v[:, j] + 1, w, 3) + 1.0
                table[j, c] = mass / mass.sum()
        odds = math.log(prior / (1 - prior)) + sum(np.log(table[j, 1, v[:, j] + 1] / table[j, 0, v[:, j] + 1]) for j in range(k))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return prior, table


def design(p: tuple[int, ...]) -> np.ndarray:
    k = len(LABELERS)
    x = [1.0]
    for vote in p[:k]:
        x += [float(vote == 1), float(vote == -1)]
    x += [float(p[k] == i) for i in range(5)] + [float(p[k + 1] == i) for i in range(4)] + [float(t) for t in p[k + 2 :]]
    return np.array(x)


def fit(counts: dict[tuple[int, ...], int], rounds: int = 60, ridge: float = 1.0) -> np.ndarray | None:
    """Weights of the span classifier: logistic regression on the patterns' probabilistic labels (Newton's method)."""
    if not counts:
        return None
    prior, table = reliabilities(counts)
    keys = sorted(counts)
    k = len(LABELERS)
    odds = np.array([math.log(prior / (1 - prior)) + sum(math.log(table[j, 1, p[j] + 1] / table[j, 0, p[j] + 1]) for j in range(k)) for p in keys])
    y = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    n = np.array([counts[p] for p in keys], dtype=float)
    x = np.stack([design(p) for p in keys])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - q)) - ridge * w)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """The span classifier of this corpus; None if no text has a candidate (then only base spans are found). Null and empty texts have none; texts that repeat count as often as they occur; the order of rows does not matter."""
    return fit(patterns(docs, text))


def find(text: str | None, weights: np.ndarray | None) -> list[tuple[str, int, int]]:
    """All spans: base ones always, further candidates where the classifier says personal; by start, then kind."""
    out = [(c[0], c[1], c[2]) for c in candidates(text) if c[3] or weights is not None and float(design(c[4]) @ weights) >= 0]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def detect(docs: DataFrame, weights: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for every row; offsets in code points, ends exclusive. Null and empty texts have no spans."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, weights)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["k", "spans"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("k", key)


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of detect()'s spans. A text without any has counts of 0, an empty span list and the digest of no text; rows repeat as in found."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with each span replaced by <KIND>; overlapping spans become one, named after the first."""
    if not text or not spans:
        return text
    out, end = [], 0
    for kind, s, e in spans:
        if s >= end:
            out += [text[end:s], f"<{kind.upper()}>"]
        end = max(end, e)
    return "".join(out) + text[end:]


def masked(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """docs with all spans of `text` masked; rows without spans, and all other columns, are untouched."""
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            new = [mask(t, find(t, weights)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return map_batches(docs, run, schema)
