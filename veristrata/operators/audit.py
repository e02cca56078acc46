"""Logs and messages made of detections and events, and passes that call out: audit lines, session texts, hybrid detection, sync."""

from __future__ import annotations

import json
import subprocess
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..tables import filesystem, replace_file
from .guard import tier


def flagged(claims: DataFrame, key: str = "id") -> DataFrame:
    """By document: its unverified and forbidden claims; the others are not audited."""
    rows = claims.where(F.col("verdict").isin("unverified", "forbidden"))
    item = F.struct("start", "end", "category", "verdict", "text", "path")
    return rows.groupBy(key).agg(F.count_if(F.col("verdict") == "forbidden").alias("forbidden"), F.count_if(F.col("verdict") == "unverified").alias("unverified"), F.sort_array(F.collect_list(item)).alias("claims"))


def status(forbidden: Column, unverified: Column) -> Column:
    return F.when(forbidden > 0, "FORBIDDEN HIT").when(unverified > 0, "flagged").otherwise("clean")


def audit_lines(events: DataFrame) -> DataFrame:
    """One JSON line per flagged edit; events: session_id, path, forbidden, unverified, recorded_at."""
    return events.where("forbidden + unverified > 0").select(F.to_json(F.struct("session_id", "path", "forbidden", "unverified", "recorded_at")).alias("value"))


AUDIT_HEADER = "# Audit log\n\nAppend-only ledger of claim verifications. Each section is one Edit/Write.\n\n"


def _day(stamp: str) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(F.col(stamp)), "yyyy-MM-dd"), F.col(stamp))


def audit_markdown(events: DataFrame) -> DataFrame:
    """(recorded_at, value): a markdown section for each event that has findings, with them, for a log that begins with AUDIT_HEADER.

    events: session_id, tool, path, timestamp (RFC 3339), recorded_at, forbidden, unverified, claims (flagged()'s, with
    text, verdict and path).
    """
    line = lambda c: F.concat(
        F.lit("- "), F.trim(F.replace(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))), F.lit(" — "), F.upper(c["verdict"]),
        F.when((c["verdict"] == "verified") & c["path"].isNotNull(), F.concat(F.lit(" (facts.yaml#"), c["path"], F.lit(")"))).when((c["verdict"] == "forbidden") & c["path"].isNotNull(), F.concat(F.lit(" (do-not-claim.md#"), c["path"], F.lit(")"))).otherwise(""), F.lit("\n"),
    )
    named = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), F.col(c), F.lit("  \n"))).otherwise("")
    who = F.concat(named("Tool", "tool"), named("Session", "session_id"))
    head = F.concat(F.lit("## "), _day("timestamp"), F.lit(" — "), F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("(unknown)")), F.lit(" — "), status(F.col("forbidden"), F.col("unverified")), F.lit("\n\n"))
    body = F.concat(head, F.lit("**Claims made:**\n"), F.array_join(F.transform("claims", line), ""), F.lit("\n"), F.when(who != "", F.concat(who, F.lit("**Timestamp:** "), F.col("timestamp"), F.lit("\n\n"))).otherwise(""))
    return events.where(F.size("claims") > 0).select("recorded_at", body.alias("value"))


def tree_edits(events: DataFrame) -> DataFrame:
    """(recorded_at, value): a section for each edit of the truth files themselves; events: session_id, tool, path, timestamp, recorded_at."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)"))
    body = F.concat(F.lit("## "), _day("timestamp"), F.lit(" — "), F.col("path"), F.lit(" — tree edit\n\n**Type:** truth-tree edit (operator-authored)  \n**Tool:** "), known("tool"), F.lit("  \n**Session:** "), known("session_id"), F.lit("  \n**Timestamp:** "), F.col("timestamp"), F.lit("\n\n"))
    return events.where("path <> ''").select("recorded_at", body.alias("value"))


def pending_decisions(events: DataFrame, policy: list[tuple[str, str, str]]) -> DataFrame:
    """One JSON line for each edit that the policy (match, scope, tier) does not skip: a draft of the decision behind it, for an operator to review."""
    hit = events.withColumn("t", tier(F.col("path"), policy)).where("t IS NOT NULL AND t.tier <> 'skip'")
    draft = F.struct("timestamp", "session_id", "tool", F.col("path").alias("file_path"), "t.scope", "t.tier", F.struct(F.col("t.scope").alias("scope"), F.array("path").alias("files")).alias("truth_change"))
    return hit.select(F.to_json(draft).alias("value"))


def write_facts(spark: SparkSession, path: str, text: str) -> None:
    """Replace a truth file: its new text is a file of its own until one rename shows it whole."""
    target, fs = filesystem(spark, path)
    fresh, _ = filesystem(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace_file(spark, fs, fresh, target)


def run_plugin(command: list[str], request: dict, seconds: float = 30, most: int = 1 << 20) -> dict:
    """An external source: JSON to its standard input, a JSON object from its output; time and size are bounded, failures are errors."""
    with tempfile.TemporaryFile() as out:
        done = subprocess.run(command, input=json.dumps(request).encode(), stdout=out, stderr=subprocess.PIPE, timeout=seconds, check=False)
        out.seek(0)
        raw = out.read(most + 1)
    if done.returncode:
        raise RuntimeError(f"exit {done.returncode}: {done.stderr[:200].decode('utf-8', 'replace')}")
    if len(raw) > most:
        raise RuntimeError(f"more than {most} bytes")
    found = json.loads(raw)
    if not isinstance(found, dict):
        raise RuntimeError("the answer is no object")
    return found


def session_start(decisions: DataFrame, source: str, limit: int = 10) -> DataFrame:
    """The last decisions as context lines; none where a session is compacted or cleared."""
    out = decisions.orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit if source not in ("compact", "clear") else 0)
    return out.select("id", F.concat(F.lit("- ["), "topic", F.lit("] "), "choice").alias("line"))


def fold_messages(rows: DataFrame, by: str, ordinal: str, text: str) -> DataFrame:
    """Adapters' texts joined by blank lines in their order; empty ones are left out."""
    kept = rows.where(F.coalesce(F.trim(text), F.lit("")) != "")
    return kept.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, text))), lambda x: x[text]), "\n\n").alias("message"))


def hybrid(docs: DataFrame, claims: DataFrame, classify: Callable[[str], bool], key: str = "id", text: str = "text") -> DataFrame:
    """Claims, and sentences without one that `classify` calls a claim (category llm, unverified); its errors skip a sentence."""
    s = docs.select(F.col(key).alias("k"), F.explode(sentences(text)).alias("s")).select("k", "s.start", "s.end", "s.text")
    c = claims.select(F.col(key).alias("ck"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    left = s.join(c, (s.k == c.ck) & (s.start < c.ce) & (s.end > c.cs), "left_anti")

    def run(batches):
        for b in batches:
            def yes(t):
                try:
                    return bool(classify(t))
                except Exception:
                    return False

            yield b[b["text"].map(yes).astype(bool)]

    kind = left.schema["k"].dataType.simpleString()
    more = left.mapInPandas(run, f"k {kind}, start int, end int, text string")
    none = F.lit(None).cast("string")
    more = more.select(F.col("k").alias(key), F.lit("llm").alias("category"), F.lit("unverified").alias("verdict"), "start", "end", "text", none.alias("subject"), none.alias("path"))
    return claims.unionByName(more)


def fact_changes(old: DataFrame, new: DataFrame, reason: str) -> DataFrame:
    """(path, old, new, reason) of leaves that differ, come or go."""
    a = old.select("path", F.col("svalue").alias("old"))
    b = new.select("path", F.col("svalue").alias("new"))
    return a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("reason", F.lit(reason))


def sync(leaves: DataFrame, fetch: Callable[[str, str], str], pattern: str) -> tuple[DataFrame, DataFrame]:
    """(new leaves, changes): leaves whose path matches are fetched anew by an injected client, in the cluster; an error is a change row and keeps the value."""

    def run(batches):
        for b in batches:
            values, errors = [], []
            for path, old in zip(b["path"], b["svalue"]):
                try:
                    values.append(fetch(path, old))
                    errors.append(None)
                except Exception as e:
                    values.append(old)
                    errors.append(str(e)[:200])
            yield pd.DataFrame({"path": b["path"], "svalue": values, "old": b["svalue"], "error": errors})

    hit = leaves.where(F.col("path").rlike(pattern))
    got = hit.select("path", "svalue").mapInPandas(run, "path string, svalue string, old string, error string")
    fresh = leaves.join(got.select("path", F.col("svalue").alias("__new")), "path", "left").withColumn("svalue", F.coalesce("__new", "svalue")).select(leaves.columns)
    return fresh, got.where("error IS NOT NULL OR NOT (svalue <=> old)").select("path", "old", F.col("svalue").alias("new"), F.coalesce("error", F.lit("synced")).alias("reason"))
