"""Claim detection in prose: forbidden statements, numeric contradictions, patterns, and verdicts from a tree of facts.

All spans are in UTF-8 bytes. Texts are scanned where they lie, in one pass over their bytes (spans.py); what is joined and
shuffled is claims, numbers and leaves.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEFT, RIGHT, WORD, byte_view, from_byte_view, matches_of, words_among
from . import spans
from .spans import Span

# ---------------------------------------------------------------- one pass over each text

_CLAIM = "stage int, category string, verdict string, start int, end int, text string, subject string, path string"


def _claims(keys, held: list[tuple[int, list[Span]]], kind: pa.DataType) -> pa.RecordBatch:
    """A row for each span of each key; keys: what the numbers in held count through."""
    at = [k for k, found in held for _ in found]
    rows = [x for _, found in held for x in found]
    column = lambda name, of: pa.array([getattr(x, name) for x in rows], of)
    text = [column(n, pa.string()) for n in ("text", "subject", "path")]
    key = keys.take(pa.array(at, pa.int64())) if isinstance(keys, pa.Array) else pa.array([keys[k] for k in at], kind)
    columns = [key, column("stage", pa.int32()), column("category", pa.string()), column("verdict", pa.string()), column("start", pa.int32()), column("end", pa.int32()), *text]
    return pa.RecordBatch.from_arrays(columns, names=["k", "stage", "category", "verdict", "start", "end", "text", "subject", "path"])


def candidates(docs: DataFrame, key: str = "id", text: str = "text", resolved: bool = False) -> DataFrame:
    """(k, stage, category, verdict, start, end, text, subject, path): what the claim patterns find in each text, in one pass over its bytes.

    resolved: whether overlaps within a text are resolved. Null and empty texts have none; rows repeat as in docs.
    """

    def run(batches):
        for b in batches:
            held = [(k, sorted(spans.candidates((t or "").encode()))) for k, t in enumerate(b.column(1).to_pylist())]
            yield _claims(b.column(0), [(k, spans.resolve(found)) for k, found in held] if resolved else held, b.schema.field(0).type)

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, {_CLAIM}")


def resolve_overlaps(claims: DataFrame) -> DataFrame:
    """Rows as candidates() gives them, from any sources: those that stay where a text's claims overlap.

    Claims are dealt by key and sorted by place; texts do not move. A sweep holds one cluster of overlapping claims.
    """
    by = ["k", "start", "stage"]
    kind = claims.schema["k"].dataType.simpleString()

    def run(batches):
        now, held, reach, kept = None, [], -1, []
        for b in batches:
            of = b.schema.field(0).type
            for k, stage, category, verdict, start, end, text, subject, path in zip(*(c.to_pylist() for c in b.columns)):
                if held and (k != now or start >= reach):
                    kept.append((now, spans.resolve(held)))
                    held, reach = [], -1
                now = k
                held.append(Span(start, stage, end, category, verdict, text, subject, path))
                reach = max(reach, end)
            if kept:
                yield _claims([k for k, _ in kept], [(i, found) for i, (_, found) in enumerate(kept)], of)
                kept = []
        if held:
            yield _claims([now], [(0, spans.resolve(held))], of)

    ordered = claims.repartition("k").sortWithinPartitions(*by)
    return ordered.select("k", *(c.split()[0] for c in _CLAIM.split(", "))).mapInArrow(run, f"k {kind}, {_CLAIM}")


def forbidden_exact(docs: DataFrame, rules: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, ord, start, end, text): rules' texts in documents, ignoring ASCII case, at ASCII word boundaries, not overlapping.

    A document meets a rule only if it has the rule's first word, which any hit holds as a whole word; what is left is
    searched once. Rules are what an operator wrote: the driver reads them, however many; only up to BROADCAST_RULES
    of them are broadcast, more are joined by word.
    """
    listed = [(r[0], r[1]) for r in rules.select("ord", "text").where("text IS NOT NULL AND text <> ''").orderBy("ord", "text").collect()]
    rows = []
    for ord_, needle in listed:
        raw = needle.encode().decode("latin-1")
        edge = [c.isascii() and (c.isalnum() or c == "_") for c in (raw[0], raw[-1])]
        pattern = f"(?i){LEFT if edge[0] else ''}{_quote(raw)}{RIGHT if edge[1] else ''}"
        first = re.search(f"[{WORD}]+", needle)
        rows.append((ord_, _ascii_lower(first[0]) if first else "", _ascii_lower(needle), pattern))
    table = docs.sparkSession.createDataFrame(rows, "ord int, w string, needle string, pattern string")
    if len(rows) <= BROADCAST_RULES:
        table = F.broadcast(table)
    low = F.translate("__t", UPPER, UPPER.lower())
    base = docs.select(F.col(key).alias("id"), F.col(text).alias("__t")).where("__t IS NOT NULL").withColumn("__low", low)
    met = base.select("id", "__t", "__low", F.explode(words_among(F.col("__low"), [r[1] for r in rows])).alias("w")).join(table, "w")
    met = met.where(F.contains("__low", F.col("needle")))
    out = met.select("id", "ord", F.explode(matches_of("__t", "pattern")).alias("m"))
    return out.select(F.col("id").alias(key), "ord", F.col("m.start").alias("start"), F.col("m.end").alias("end"), from_byte_view(F.col("m.text")).alias("text"))


BROADCAST_RULES = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _quote(s: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() or c == " " else f"\\x{ord(c):02x}" for c in s)


def contradictions(docs: DataFrame, leaves: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, start, end, value, path, text): numbers that differ from every numeric leaf but resemble one whose path the words around it name.

    An inverted index over the leaves has, for each order of magnitude and segment of a path (of three bytes or more),
    the least path: so its size follows the names in the tree, not the number of leaves, and no row holds a list of
    leaves. A number meets it by its magnitude and the runs of three bytes of its context, one of which begins any segment
    that the context holds. The least path is reported. Years are left out on both sides; a number that equals a leaf
    contradicts none.
    """
    numeric = leaves.where("nvalue IS NOT NULL AND NOT (nvalue >= 1900 AND nvalue <= 2100 AND nvalue = floor(nvalue))")
    segments = F.filter(F.split(F.lower("path"), r"[._\[\]]+"), lambda s: F.octet_length(s) >= 3)
    named = numeric.where("nvalue > 0").select("path", F.floor(F.log10("nvalue")).alias("m"), F.explode(segments).alias("segment")).groupBy("m", "segment").agg(F.min("path").alias("path"))
    named = named.select("path", "segment", F.explode(F.array(F.col("m") - 1, F.col("m"), F.col("m") + 1)).alias("m")).groupBy("m", "segment").agg(F.min("path").alias("path"))
    named = named.withColumn("gram", F.substring(byte_view(F.col("segment")), 1, 3))

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            rows = [(k, *n, t[n[0] : n[1]].decode()) for k, t in enumerate(raw) for n in spans.numbers(t)]
            at, start, end, value, context, said = zip(*rows) if rows else ((),) * 6
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.float64()), pa.array(context, pa.string()), pa.array(said, pa.string()), pa.array([spans.grams(c) for c in context], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "end", "v", "ctx", "text", "grams"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, start int, end int, v double, ctx string, text string, grams array<string>").where("v > 0")
    found = found.join(numeric.select(F.col("nvalue").alias("v")).distinct(), "v", "left_anti")
    met = found.select("k", "start", "end", "v", "text", "ctx", F.floor(F.log10("v")).alias("m"), F.explode("grams").alias("gram")).join(named, ["m", "gram"]).where(F.contains("ctx", F.col("segment")))
    out = met.groupBy("k", "start", "end", "v", "text").agg(F.min("path").alias("path"))
    return out.select(F.col("k").alias(key), "start", "end", F.col("v").alias("value"), "path", "text")


def detect(docs: DataFrame, leaves: DataFrame, forbidden: DataFrame | None = None, contradicted: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(key, category, verdict, start, end, text, subject, path) of every claim.

    forbidden: (key, ord, start, end[, text]) of fuzzy.forbidden() or forbidden_exact(), contradicted: contradictions()' rows;
    both optional; with them keys must be distinct. Each text is read once, where it is; what moves is claims. A claim
    from outside whose text is not told is read off its document by a join.
    """
    none = F.lit(None).cast("string")
    if forbidden is None and contradicted is None:
        claims = candidates(docs, key, text, resolved=True)
    else:
        claims = candidates(docs, key, text)
        for rows, stage, verdict, path in ((forbidden, 0, "forbidden", lambda: F.concat(F.lit("#"), F.col("ord"))), (contradicted, 1, "contradiction", lambda: F.col("path"))):
            if rows is not None:
                told = F.col("text") if "text" in rows.columns else none
                claims = claims.unionByName(rows.select(F.col(key).alias("k"), F.lit(stage).alias("stage"), F.lit(verdict).alias("category"), F.lit(verdict).alias("verdict"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), told.alias("text"), none.alias("subject"), path().alias("path")))
        claims = resolve_overlaps(claims)
        untold = [rows for rows in (forbidden, contradicted) if rows is not None and "text" not in rows.columns]
        if untold:
            base = docs.select(F.col(key).alias("k"), byte_view(F.col(text)).alias("__b"))
            few = claims.where("text IS NULL").join(base, "k").withColumn("text", from_byte_view(F.expr("substring(__b, start + 1, end - start)"))).drop("__b")
            claims = claims.where("text IS NOT NULL").unionByName(few)
    subject = F.lower(F.rtrim(F.replace(F.col("subject"), F.lit(","), F.lit("")), F.lit(".,;!?")))
    known = leaves.groupBy(F.lower("svalue").alias("__v")).agg(F.min("path").alias("__path"))
    claims = claims.withColumn("__v", F.when(F.col("verdict") == "unverified", subject)).join(known, "__v", "left")
    found = (F.col("verdict") == "unverified") & F.col("__path").isNotNull()
    return claims.select(
        F.col("k").alias(key), "category", F.when(found, "verified").otherwise(F.col("verdict")).alias("verdict"), "start", "end", "text", "subject", F.when(found, F.col("__path")).otherwise(F.col("path")).alias("path")
    )


def summary(claims: DataFrame, key: str = "id") -> DataFrame:
    """Counts by verdict for each document that has a claim."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "unverified", "forbidden", "opinion", "contradiction")]
    return claims.groupBy(key).agg(F.count("*").alias("total"), *counts)


def severity(summaries: DataFrame) -> DataFrame:
    """The exit code of a scan: 2 with a forbidden claim, 1 with an unverified or contradicted one, else 0."""
    code = F.when(F.col("forbidden") > 0, 2).when(F.col("unverified") + F.col("contradiction") > 0, 1).otherwise(0)
    return summaries.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def corpus_summary(docs: DataFrame, summaries: DataFrame, key: str = "id") -> DataFrame:
    """One row for a scan: files, files with a forbidden claim, else with an unverified one, and the message that says so.

    summaries: summary()'s rows; documents without any claim have none.
    """
    counts = summaries.agg(F.count_if(F.col("forbidden") > 0).alias("with_forbidden"), F.count_if((F.col("forbidden") == 0) & (F.col("unverified") > 0)).alias("with_unverified"))
    total = docs.agg(F.count("*").alias("files"))
    both = total.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k").drop("k")
    say = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))
    found = F.concat_ws(", ", say("with_forbidden", " with forbidden claims"), say("with_unverified", " with unverified claims"))
    return both.withColumn("message", F.concat(F.col("files").cast("string"), F.lit(" files: "), F.when(found == "", "no findings").otherwise(found)))


def quality(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """Confusion counts, precision, recall, and the rates of false positives and negatives; null where a denominator is 0."""
    p, y = F.col(predicted), F.col(label)
    out = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn"), "fp_rate": ratio("fp", "tn"), "fn_rate": ratio("fn", "tp")})


# ---------------------------------------------------------------- facts


def truth_stats(facts: DataFrame, rules: DataFrame | None = None, n_stories: int = 0) -> DataFrame:
    """(kind, name, n): facts by top-level category, rules by category, and the number of stories."""
    category = F.split(F.regexp_replace("path", r"\[.*$", ""), r"\.")[0]
    out = facts.groupBy(category.alias("name")).agg(F.count("*").alias("n")).select(F.lit("facts").alias("kind"), "name", "n")
    if rules is not None:
        out = out.unionByName(rules.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n")).select(F.lit("rules").alias("kind"), "name", "n"))
    return out.unionByName(facts.sparkSession.createDataFrame([("stories", "", n_stories)], "kind string, name string, n bigint"))


def at_path(leaves: DataFrame, path: str) -> DataFrame:
    """The leaves under a key path such as a.b[0]; an empty path is all. Paths that name nothing are an error, which says where they end."""
    if path and not re.fullmatch(r"[^.\[\]]+(\[\d+\])*(\.[^.\[\]]+(\[\d+\])*)*", path):
        raise ValueError(f"{path}: not a key path")
    steps = re.findall(r"\[\d+\]|[^.\[\]]+", path)
    seen = ""
    for step in steps:
        longer = seen + step if step.startswith("[") or not seen else f"{seen}.{step}"
        if leaves.where(_under(longer)).isEmpty():
            kind = "index" if step.startswith("[") else "key"
            raise ValueError(f"{path}: {kind} {step} not found under {seen or 'the root'}")
        seen = longer
    return leaves.where(_under(path)) if path else leaves


def _under(path: str) -> Column:
    return (F.col("path") == path) | F.startswith("path", F.lit(path + ".")) | F.startswith("path", F.lit(path + "["))


def visible_facts(leaves: DataFrame, category: str = "") -> DataFrame:
    """Leaves under a dotted category, without subtrees marked private, by path."""
    private = leaves.where("path RLIKE '(^|[.])sensitivity$' AND lower(svalue) = 'private'").selectExpr("regexp_replace(path, '[.]?sensitivity$', '') AS prefix")
    out = leaves.where(_under(category)) if category else leaves
    # subtrees are found through the leaf's own ancestors: an equi-join, whatever the tree's size
    up = out.select("path", F.explode(F.expr("transform(filter(sequence(1, length(path)), i -> i = length(path) OR substring(path, i + 1, 1) IN ('.', '[')), i -> substring(path, 1, i))")).alias("prefix"))
    hidden = up.join(private, "prefix", "left_semi").select("path").distinct()
    return out.join(hidden, "path", "left_anti")


def stale_facts(leaves: DataFrame, today: str, days: int = 180) -> DataFrame:
    """last_verified leaves older than `days`, or not a date."""
    rows = leaves.where("path RLIKE '(^|[.])last_verified$'")
    when = F.expr("try_cast(svalue AS date)")
    return rows.where(when.isNull() | (when < F.date_sub(F.lit(today).cast("date"), days))).select("path", "svalue")


def facts_impact(docs: DataFrame, leaves: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, key, hits, strong_hits, first_line): where facts' values occur in documents, ignoring case, at word boundaries.

    A hit is strong if the three words before or after it name a segment of the leaf's path; first_line is that of the
    first strong hit, or of the first hit. Of a document's words only those go on that begin a leaf (the leaves are what
    an operator wrote; the driver reads their first words), so a text is copied for possible matches only.
    """
    terms = leaves.where("svalue <> ''").select("path", F.lower("svalue").alias("term"))
    view = byte_view(F.col("term"))
    edge = lambda at, look: F.when(F.col("term").rlike(at), F.lit(look)).otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(view, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    segments = F.filter(F.split(F.lower("path"), r"[._\[\]]+"), lambda s: F.octet_length(s) >= 3)
    terms = terms.select("path", "term", F.regexp_extract("term", f"[{WORD}]+", 0).alias("w"), F.concat(edge(f"^[{WORD}]", LEFT), quoted, edge(f"[{WORD}]$", RIGHT)).alias("pattern"), segments.alias("segments"))
    words = docs.select(F.col(key).alias("k"), F.lower(text).alias("t")).where("t IS NOT NULL")
    firsts = [r[0] for r in terms.select("w").distinct().collect()]
    words = words.select("k", "t", F.explode(words_among(F.col("t"), firsts)).alias("w"))
    hit = words.join(terms, "w").where(F.contains("t", F.col("term")))
    hit = hit.select("path", "k", "segments", byte_view(F.col("t")).alias("q"), matches_of("t", "pattern").alias("m")).where("size(m) > 0")
    three = r"'^\\s*+(?:\\S++\\s++){0,2}+\\S*+'"
    context = f"concat(reverse(regexp_extract(reverse(substring(q, 1, h.start)), {three}, 0)), ' ', regexp_extract(substring(q, h.end + 1), {three}, 0))"
    strong = F.expr(f"filter(m, h -> exists(segments, s -> contains(regexp_replace({context}, '\\\\s+', ' '), decode(encode(s, 'UTF-8'), 'ISO-8859-1'))))")
    hit = hit.withColumn("strong", strong).withColumn("at", F.expr("coalesce(get(strong, 0).start, m[0].start)"))
    line = F.expr("1 + length(substring(q, 1, at)) - length(replace(substring(q, 1, at), '\n', ''))")
    return hit.select("path", F.col("k").alias(key), F.size("m").alias("hits"), F.size("strong").alias("strong_hits"), line.alias("first_line"))
