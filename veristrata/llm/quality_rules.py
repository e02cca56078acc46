"""Quality rules as a short-circuit cascade. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: name: the condition under which a text is rejected, over base columns and the text `__t`, and the characters that it reads.
#: Base columns are in every row of the result, so a rule over them reads none. Order is not meant: order_rules() finds it.
RULES = {
    "symbols": ("10 * n_symbols > 3 * n_words", "0"),
    "repeated_lines": ("10 * n_dup_lines > 3 * n_lines", "0"),
    "word_length": ("word_chars > 20 * n_words OR word_chars < 2 * n_words", "0"),
    "shouting": ("10 * (size(split(__t, '[A-Z]', -1)) - 1) > 4 * word_chars", "length(__t)"),
    "exclaims": ("10 * (size(split(__t, '!', -1)) - 1) > 5 * n_words", "length(__t)"),
    "punctuation_only": ("NOT (__t RLIKE '[\\\\p{L}]')", "coalesce(nullif(regexp_instr(__t, '[\\\\p{L}]'), 0), length(__t))"),
}


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and `__t`.

    Null text counts as empty: all zero. Nothing is exploded or shuffled: windows are hashed inside the row's
    arrays, and only rows in which a window hash repeats are sorted for their positions.
    """
    t = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    t = t.withColumn("__w", F.array_remove(F.split("__t", WORD_BREAK), ""))
    line_ok = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumn("__l", line_ok)
    t = t.withColumn(
        "__h",
        F.when(
            F.size("__w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    t = t.withColumn("n_words", F.size("__w").cast("long"))
    t = t.withColumn("word_chars", F.aggregate("__w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)))
    t = t.withColumn("n_symbols", (F.size(F.split("__t", SYMBOLS, -1)) - 1).cast("long"))
    t = t.withColumn("n_lines", F.size("__l").cast("long"))
    t = t.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    t = t.withColumn("__s", F.when(repeats, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.expr("filter(__s, (x, k) -> (k > 0 AND __s[greatest(k - 1, 0)].h = x.h) OR (k < size(__s) - 1 AND __s[least(k + 1, size(__s) - 1)].h = x.h))")
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    t = t.withColumn("n_repeat_words", covered)
    return t.drop("__w", "__l", "__h", "__s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def order_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, text: str = "text", sample_rows: int = 512) -> list[dict]:
    """Rules by rejection per cost, dearest per rejection last; with what was measured.

    Both come from a sample of at most sample_rows distinct texts, those of least hash, so from everywhere in the table,
    as far as these pass the base: selectivity is the share that a rule rejects, cost the mean number of characters that
    it reads, and one for the rule itself. So equal tables give equal orders, on any machine and in any order of rows.
    Only flags and counts of the sample reach the driver, never texts. The order moves work, never a verdict.
    """
    facts = [F.expr(x).alias(f"{kind}_{k}") for k, pair in enumerate(rules.values()) for kind, x in zip(("rejects", "reads"), pair)]
    # a hash under a bound that leaves a few times the sample: rows are counted without reading texts
    share = min(1.0, 8 * sample_rows / max(1, docs.count()))
    hashed = docs.select(F.col(text)).withColumn("__hash", F.xxhash64(F.col(text)))
    few = hashed.where(F.col("__hash") <= F.lit(min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))).dropDuplicates(["__hash"]).orderBy("__hash").limit(sample_rows)
    sample = base_columns(few.select(text), text).select(base_failed().alias("failed"), *facts).collect()
    sample = [r for r in sample if not r["failed"]]
    n = len(sample)
    out = []
    for k, name in enumerate(rules):
        rate = (sum(bool(r[f"rejects_{k}"]) for r in sample) + 0.5) / (n + 1)
        cost = 1 + sum(r[f"reads_{k}"] or 0 for r in sample) / max(n, 1)
        out.append({"rule": name, "rejects": rate, "cost": cost, "score": rate / cost})
    return sorted(out, key=lambda r: (-r["score"], r["rule"]))


def cascade(order: list[str], rules: dict[str, tuple[str, str]] = RULES) -> Column:
    """True for texts that no rule rejects; CASE evaluates a rule only where those before it passed."""
    out = F.when(base_failed(), F.lit(False))
    for name in order:
        out = out.when(F.expr(rules[name][0]), F.lit(False))
    return out.otherwise(F.lit(True))


def filter_quality(docs: DataFrame, text: str = "text", rules: dict[str, tuple[str, str]] = RULES, sample_rows: int = 512) -> DataFrame:
    """docs' rows with the base columns, base_failed and kept.

    Null and empty texts fail the base (no words). Rows repeat as in docs; an empty table gives an empty one.
    Columns of docs with the names of computed ones are replaced.
    """
    order = [r["rule"] for r in order_rules(docs, rules, text, sample_rows)]
    out = base_columns(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", cascade(order, rules)).drop("__t")
