"""Forbidden statements with a few edits: a window scan over bytes, batched through Arrow."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialize, spread
from .detect import BROADCAST_RULES, forbidden_exact

_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_RUNS = re.compile(rb"[0-9]+")


def edit_distance(a: bytes, b: bytes, cap: int) -> int:
    """Levenshtein distance by bytes, or cap + 1 where it is more; only the diagonal band is filled."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    # what both ends share needs no edit
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[len(a) - 1 - last] == b[len(b) - 1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    # row[d] is the distance of a[:i] and b[:i + d - cap]
    width = 2 * cap + 1
    row = [d - cap if d >= cap else cap + 1 for d in range(width)]
    for i, x in enumerate(a, 1):
        least = cap + 1
        left = cap + 1
        for d in range(width):
            j = i + d - cap
            if j < 0 or j > len(b):
                left = row[d] = cap + 1
                continue
            up = row[d + 1] + 1 if d + 1 < width else cap + 1
            best = i if j == 0 else min(row[d] + (x != b[j - 1]), up, left + 1)
            left = row[d] = min(best, cap + 1)
            least = min(least, left)
        if least > cap:
            return cap + 1
    return row[len(b) - len(a) + cap]


def bounded_distance(cap: int):
    """A column function of two texts: edit_distance() of their bytes; null if one is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_distance(x.encode(), y.encode(), cap) for x, y in zip(a, b)], dtype="Int32")

    return F.pandas_udf(run, "int")


def _bounded(text: bytes, start: int, end: int, needle: bytes) -> bool:
    left = needle[0] not in _WORD or start == 0 or text[start - 1] not in _WORD
    return left and (needle[-1] not in _WORD or end >= len(text) or text[end] not in _WORD)


def exact(text: bytes, needle: bytes) -> list[tuple[int, int]]:
    """Non-overlapping hits, ignoring ASCII case, at word boundaries; a rejected hit moves on by one byte."""
    low, want, out, at = text.lower(), needle.lower(), [], 0
    while want and (at := low.find(want, at)) >= 0:
        if _bounded(text, at, at + len(want), needle):
            out.append((at, at + len(want)))
            at += len(want)
        else:
            at += 1
    return out


def fuzzy(text: bytes, needle: bytes, threshold: int) -> list[tuple[int, int]]:
    """exact() and windows within `threshold` edits, left to right. Windows start and end at word boundaries where the
    needle does, keep off exact hits, and keep the needle's digit runs; the needle's own length is tried first.

    A window with few edits shares one of threshold + 1 pieces of the needle: where none is near, nothing is compared.
    """
    hits = exact(text, needle)
    n = len(needle)
    if threshold <= 0 or not n or not text:
        return hits
    low, want = text.lower(), needle.lower()
    smallest = max(1, n - threshold)
    sizes = [w for d in range(threshold + 1) for w in ((n,) if not d else (n + d, n - d)) if smallest <= w <= len(text)]
    runs = _RUNS.findall(want)
    cuts = [n * k // (threshold + 1) for k in range(threshold + 2)]
    starts: set[int] = set()
    for a, b in zip(cuts, cuts[1:]):
        piece = want[a:b]
        at = low.find(piece) if piece else -1
        while at >= 0:
            starts.update(range(max(0, at - a - threshold), at - a + threshold + 1))
            at = low.find(piece, at + 1)
        if not piece:
            starts.update(range(len(text)))
    found, resume = [], 0
    for i in sorted(starts):
        if i < resume or i > len(low) - smallest:
            continue
        clash = next((e for s, e in hits if i < e and i + smallest > s), None)
        if clash is not None:
            resume = clash
            continue
        if needle[0] in _WORD and i and text[i - 1] in _WORD:
            continue
        for w in sizes:
            end = i + w
            if end > len(low) or any(i < e and end > s for s, e in hits) or not _bounded(text, i, end, needle):
                continue
            if w > n and needle[-1] in _WORD and i + n < len(low) and text[i + n] in _WORD:
                continue
            if edit_distance(low[i:end], want, threshold) <= threshold and (not runs or _RUNS.findall(low[i:end]) == runs):
                found.append((i, end))
                resume = end
                break
    return sorted(hits + found)


def forbidden(docs: DataFrame, rules: DataFrame, key: str = "id", text: str = "text", default_fuzz: int = 1) -> DataFrame:
    """(key, ord, start, end, text) of all rules, each with its own number of edits (fuzz, else the default); those without any stay in the JVM.

    More than BROADCAST_RULES rules are joined with the texts instead (joined()): the rows are the same.
    """
    if "fuzz" not in rules.columns:
        rules = rules.withColumn("fuzz", F.lit(default_fuzz))
    rules = rules.withColumn("fuzz", F.coalesce(F.col("fuzz").cast("int"), F.lit(default_fuzz)))
    if rules.limit(BROADCAST_RULES + 1).count() > BROADCAST_RULES:
        return joined(docs, rules, key, text)
    near = forbidden_fuzzy(docs, rules.where("fuzz > 0"), default_fuzz, key, text)
    return forbidden_exact(docs, rules.where("fuzz <= 0"), key, text).unionByName(near)


# ---------------------------------------------------------------- rules that no driver or task holds

#: Lengths of the anchors that pieces of needles are found by: a piece has the longest that fits.
ANCHORS = (12, 8, 5, 3, 2, 1, 0)
#: Bits of the filter that a text's runs of bytes must pass before they are joined: its size is fixed, 2 MB.
FILTER_BITS = 1 << 24
_BASE = 0x9E3779B97F4A7C15


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` bytes, by place; it only proposes rules."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size + 1, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(_BASE) + raw[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors_of(needle: bytes, threshold: int) -> set[tuple[int, int]]:
    """(length, hash): one for each of threshold + 1 pieces of a needle. A window with no more edits than that holds one of them."""
    want = np.frombuffer(needle.lower(), dtype=np.uint8)
    count = max(threshold, 0) + 1
    cuts = [len(want) * k // count for k in range(count + 1)]
    out = set()
    for a, b in zip(cuts, cuts[1:]):
        size = next(x for x in ANCHORS if x <= b - a)
        out.add((size, int(_hashes(want[a : a + size], size)[0].astype(np.int64)) if size else 0))
    return out


#: Rules of one text, and keys of one text, are dealt to groups of about so many, so that no row or task holds all of them.
RULE_GROUP = KEY_GROUP = 1024
#: Of a group's rules so many are given to each of its keys at once: a file of the rows has a key once a run, and the run again and again.
RULE_RUN = 256
#: Pairs of groups that a task deals out: few enough that the different keys and rules in its file fit the file's dictionaries.
TASK_PAIRS = 32


def _found(docs: DataFrame, listed: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the hits (d, needle, fuzz, start, end, text) of every different needle in every different text, and of (k, d): the digests of such texts by key.

    Each needle's pieces are rows with the hash of an anchor; a text gives the hashes of its runs of those lengths that
    pass a filter of all anchors (a bitmap of fixed size, built by an aggregate; the only thing that reaches the driver).
    Documents are read once: texts with such runs go to a table, and others are shuffled nowhere. Texts and needles that
    share a hash meet by a join, and a text is then read once beside its needles, which stream past it.
    """

    def pieces(batches):
        for b in batches:
            rows = [(n, f, size, h) for n, f in zip(*(c.to_pylist() for c in b.columns)) for size, h in anchors_of(n.encode(), f)]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["needle", "fuzz", "size", "h"])

    anchors = materialize(listed.select("needle", "fuzz").distinct().mapInArrow(pieces, "needle string, fuzz int, size int, h long"), "anchors")
    slot = F.pmod(F.col("h"), F.lit(FILTER_BITS)) + 1  # Spark numbers the bits of a bitmap from 1
    maps = anchors.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    sizes = sorted(r[0] for r in anchors.select("size").distinct().collect())
    packed = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in maps:
        part = np.frombuffer(r["bits"], np.uint8)
        packed[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part

    def runs(batches):
        known = np.unpackbits(packed, bitorder="little").view(bool)
        for b in batches:
            names, texts, at, hashes, seen = [], [], [], [], {}
            for row, (d, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                first = d not in seen
                if first:
                    raw, met = np.frombuffer(t.encode().lower(), dtype=np.uint8), []
                    for size in sizes:
                        h = _hashes(raw, size) if size else np.zeros(1, np.uint64)
                        h = h[known[(h & np.uint64(FILTER_BITS - 1)).astype(np.int64)]]  # few are left to be told apart
                        met.append(np.unique(h).astype(np.int64))
                    hashes += met
                    seen[d] = sum(map(len, met)) > 0
                    at += [row] * sum(map(len, met))
                if seen[d]:
                    names.append(row)
                    texts.append(row if first else None)
            rows, none = pa.array(names + at, pa.int64()), [None] * len(at)
            columns = [b.column(0).take(pa.array(names + none, pa.int64())), b.column(1).take(rows), b.column(2).take(pa.array(texts + none, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([None] * len(names) + np.concatenate(hashes or [[]]).tolist(), pa.int64())], names=["k", "d", "t", "h"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''").select("k", F.sha2("t", 256).alias("d"), "t")
    near = materialize(src.mapInArrow(runs, f"k {src.schema['k'].dataType.simpleString()}, d string, t string, h long"), "near")
    met = near.where("h IS NOT NULL").select("d", "h").join(anchors, "h").groupBy("d", "needle", "fuzz").agg(F.lit(1).alias("kind"))
    whole = near.where("t IS NOT NULL").join(met.select("d").distinct(), "d", "left_semi").groupBy("d").agg(F.first("t").alias("t"))
    whole = whole.select("d", F.lit(0).alias("kind"), "t", F.lit(None).cast("int").alias("fuzz"))
    dealt = whole.unionByName(met.select("d", "kind", F.col("needle").alias("t"), "fuzz")).repartition("d").sortWithinPartitions("d", "kind", "t", "fuzz")

    def scan(batches):
        raw = b""
        for b in batches:
            at, rows = [], []
            for row, (which, t, f) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 4)))):
                if which == 0:
                    raw = (t or "").encode()
                    continue
                hits = [(t, f, s, e, raw[s:e].decode("utf-8", "replace")) for s, e in fuzzy(raw, t.encode(), f)]
                at += [row] * len(hits)
                rows += hits
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["d", "needle", "fuzz", "start", "end", "text"])

    found = dealt.select("d", "kind", "t", "fuzz").mapInArrow(scan, "d string, needle string, fuzz int, start int, end int, text string")
    hits = materialize(found, "hits")
    discard(anchors)
    return hits, near


def _groups(rows: DataFrame, by: list[str], item: str, salt: Column, size: int, name: str) -> DataFrame:
    """A table of the items of each `by`, nulls too, in lists (`name`) of about `size`."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("groups"))
    dealt = rows.withColumn("salt", salt).join(counts, by).withColumn(f"{name}_group", F.pmod("salt", "groups"))
    lists = dealt.groupBy(*by, f"{name}_group").agg(F.collect_list(F.struct(item)).alias(name))
    return materialize(lists.withColumn(name, F.transform(name, lambda x: x[item])), name)


def _of_all(hits: DataFrame, near: DataFrame, listed: DataFrame) -> DataFrame:
    """A row for each hit, each key that has its text and each rule that has its needle (k, ord, and the hit's columns).

    Rules of one needle go in groups of about RULE_GROUP, keys of one text in groups of about KEY_GROUP. Pairs of groups are
    what is shuffled, so that the rows, which grow with the square of the copies, are first made by the task that has them last.
    """
    rule = ["needle", "fuzz"]
    named = near.where("h IS NULL").select("k", "d", F.monotonically_increasing_id().alias("salt"))
    keys = _groups(named.join(hits.select("d").distinct(), "d", "left_semi"), ["d"], "k", F.xxhash64("salt"), KEY_GROUP, "ks")
    discard(near)
    ords = _groups(listed.join(hits.select(*rule).distinct(), rule, "left_semi"), rule, "ord", F.xxhash64("ord"), RULE_GROUP, "ords")
    pairs = hits.join(keys, "d").join(ords, rule)
    pairs = spread(pairs, "d", *rule, "ks_group", "ords_group", least=pairs.count() // TASK_PAIRS)
    run = F.explode(F.expr(f"transform(sequence(0, (size(ords) - 1) div {RULE_RUN}), i -> slice(ords, int(i * {RULE_RUN} + 1), {RULE_RUN}))"))
    return pairs.withColumn("ords", run).withColumn("k", F.explode("ks")).withColumn("ord", F.explode("ords")).drop("d", "ks", "ords", "ks_group", "ords_group")


def _listed(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("ord").cast("int").alias("ord"), F.col("text").alias("needle"), F.coalesce(F.col("fuzz").cast("int"), F.lit(0)).alias("fuzz")).where("needle IS NOT NULL AND needle <> ''")


def joined(docs: DataFrame, rules: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ord, start, end, text): what fuzzy() finds of every rule (ord, text, fuzz) in every text, for rules of any number.

    Equal needles are sought once, and in equal texts once; hits are then given to all keys and rules that have them.
    Null and empty texts and rules have no hits; a key that comes twice has the hits of each of its texts.
    """
    listed = _listed(rules)
    hits, near = _found(docs, listed, key, text)
    return _of_all(hits, near, listed).select(F.col("k").alias(key), "ord", "start", "end", "text")


def matched(docs: DataFrame, rules: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ord): the rules with a hit in a text, each once a text and rule, as joined() finds them; nothing is compared after hits are dealt."""
    listed = _listed(rules)
    hits, near = _found(docs, listed, key, text)
    return _of_all(hits.select("d", "needle", "fuzz").distinct(), near, listed).select(F.col("k").alias(key), "ord")


class Pieces:
    """Which needles can occur in a text with up to their threshold of edits: one pass over the text for all of them."""

    def __init__(self, needles: list[tuple[bytes, int]]):
        import ahocorasick

        self.always: list[int] = []
        self.found = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, (needle, threshold) in enumerate(needles):
            want, parts = needle.lower().decode("latin-1"), max(threshold, 0) + 1
            cuts = [len(want) * k // parts for k in range(parts + 1)]
            pieces = {want[a:b] for a, b in zip(cuts, cuts[1:])}
            if "" in pieces:
                self.always.append(i)
            else:
                for p in pieces:
                    by.setdefault(p, []).append(i)
        for p, which in by.items():
            self.found.add_word(p, which)
        self.any = bool(by)
        if self.any:
            self.found.make_automaton()

    def near(self, text: bytes) -> list[int]:
        out = set(self.always)
        if self.any:
            for _, which in self.found.iter(text.lower().decode("latin-1")):
                out.update(which)
        return sorted(out)


def forbidden_fuzzy(docs: DataFrame, rules: DataFrame, threshold: int = 1, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ord, start, end, text) for each rule's hits. rules: (ord, text[, fuzz]); fuzz is a rule's own number of edits, else threshold.

    Rules are what an operator wrote: the driver reads them, however many. A text is scanned once for the pieces of all
    rules; only rules of which a piece occurs are compared with it.
    """
    fuzz = F.coalesce(F.col("fuzz").cast("int"), F.lit(threshold)) if "fuzz" in rules.columns else F.lit(threshold)
    listed = [(r[0], r[1].encode(), r[2]) for r in rules.select("ord", "text", fuzz.alias("fuzz")).where("text IS NOT NULL AND text <> ''").orderBy("ord", "text").collect()]

    def run(batches):
        pieces = Pieces([(needle, f) for _, needle, f in listed])
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                raw = (t or "").encode()
                for i in pieces.near(raw) if raw else ():
                    ord_, needle, f = listed[i]
                    rows += [(k, ord_, s, e, raw[s:e].decode("utf-8", "replace")) for s, e in fuzzy(raw, needle, f)]
            yield pd.DataFrame(rows, columns=["k", "ord", "start", "end", "text"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {src.schema['k'].dataType.simpleString()}, ord int, start int, end int, text string").withColumnRenamed("k", key)
