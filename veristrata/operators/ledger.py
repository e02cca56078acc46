"""The ledger of decisions and claims: reads, supersession, expiry, and changes as functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import human_duration, one_line
from ..tables import discard, materialize


def supersede_claims(claims: DataFrame) -> DataFrame:
    """claims with superseded_by: the first later success that clears the claim.

    A success is verified with its verifier run. It clears earlier unverified claims of its own file, and earlier
    explicit failures of any file. Both are found by block, of a file and of the whole table: ids are cut into blocks,
    a later block's first success comes from a small table of block minima, and only the claim's own block is
    ordered. No window spans the table or a hot file, and all run backwards, so that a frame grows by a row at a time.
    """
    success = F.when(F.col("verified") & F.col("vet_ok").isNotNull(), F.col("id"))
    rows = claims.withColumn("__t", success).withColumn("__block", F.floor(F.col("id") / F.lit(BLOCK)).cast("long"))

    def later(keys: list[str], name: str) -> DataFrame:
        """By key and block: the first success of the key in a later block."""
        firsts = rows.groupBy(*keys, "__block").agg(F.min("__t").alias("__first"))
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
        return firsts.select(*keys, "__block", F.min("__first").over(w).alias(name))

    def near(keys: list[str]):
        return F.min("__t").over(Window.partitionBy(*keys, "__block").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1))

    out = rows.withColumn("__own", near(["file_path"])).join(later(["file_path"], "__own_next"), ["file_path", "__block"], "left")
    out = out.withColumn("__any", near([])).join(later([], "__any_next"), "__block", "left")
    in_file = F.when(F.col("file_path").isNotNull(), F.coalesce("__own", "__own_next"))
    anywhere = F.when(F.col("vet_ok") == F.lit(False), F.coalesce("__any", "__any_next"))
    pointer = F.when(~F.col("verified"), F.least(in_file, anywhere))
    return out.withColumn("superseded_by", pointer).select(*claims.columns, "superseded_by")


#: Ids in a block of supersede_claims(); the table of block minima has a row for each so many ids.
BLOCK = 1 << 16


def unverified(claims: DataFrame, session: str | None = None, all_rows: bool = False) -> DataFrame:
    out = claims.where("NOT verified")
    out = out if all_rows else out.where("superseded_by IS NULL")
    out = out.where(F.col("session_id") == session) if session else out
    return out.orderBy(F.desc("recorded_at"), F.desc("id")).limit(schema.STORE_ROWS)


def stale(claims: DataFrame, now: int, session: str | None = None) -> DataFrame:
    """Verified claims whose check has run out; the boundary itself is not stale, no ttl never is."""
    out = claims.where("verified AND ttl IS NOT NULL AND superseded_by IS NULL").where(F.coalesce("last_checked", "recorded_at") + F.col("ttl") < now)
    out = out.where(F.col("session_id") == session) if session else out
    return out.orderBy(F.desc("recorded_at"), F.desc("id")).limit(schema.STORE_ROWS)


def within_bytes(rows: DataFrame, size, order: list, budget: int = schema.RESPONSE_BYTES) -> DataFrame:
    """The prefix of an already limited list whose sizes add up to the budget; the first row always stays."""
    w = Window.orderBy(*order)
    out = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("__rn") == 1) | (F.col("__sum") <= budget)).drop("__rn", "__sum")


def unverified_listing(claims: DataFrame, limit: int = 0, budget: int = schema.RESPONSE_BYTES) -> DataFrame:
    """The tool's list: limited, with source auto or operator, within the byte budget."""
    rows = unverified(claims).limit(schema.clamp(limit, schema.UNVERIFIED_ROWS))
    rows = rows.withColumn("source", F.when(F.col("tool").isNull(), "operator").otherwise("auto"))
    return within_bytes(rows, F.octet_length("claim") + F.octet_length(F.coalesce("file_path", F.lit(""))) + 64, [F.desc("recorded_at"), F.desc("id")], budget)


def resolve(claims: DataFrame, id: int, note: str = "") -> DataFrame:
    """Verified by hand; the evidence says so."""
    trimmed = note.strip()
    raw = trimmed.encode()
    if len(raw) > schema.NOTE_BYTES:
        trimmed = raw[: schema.NOTE_BYTES].decode("utf-8", "ignore") + " …(truncated)"
    suffix = "\n\nmanually resolved by operator" + (f": {trimmed}" if trimmed else "")
    hit = F.col("id") == id
    return claims.withColumn("evidence", F.when(hit, F.concat(F.coalesce("evidence", F.lit("")), F.lit(suffix))).otherwise(F.col("evidence"))).withColumn("verified", hit | F.col("verified"))


def touch(claims: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """last_checked of these ids is now; others change nothing (missing() names them)."""
    hit = ids.select(F.col("id"), F.lit(True).alias("__hit")).distinct()
    out = claims.join(hit, "id", "left").withColumn("last_checked", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("last_checked")))
    return out.select(claims.columns)


def missing(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that no claim has."""
    return ids.select("id").distinct().join(claims.select("id"), "id", "left_anti")


# Texts of claims that older versions recorded for edits they had refused.
REFUSED = ("path escapes project root", "index=skipped (file not found)")


def drop_refused(claims: DataFrame) -> DataFrame:
    """Without claims about refused edits; running it again changes nothing."""
    gone = F.lit(False)
    for text in REFUSED:
        gone = gone | F.contains("claim", F.lit(text))
    return claims.where(~F.coalesce(gone, F.lit(False)))


def purge(claims: DataFrame, before: int) -> DataFrame:
    """Without superseded automatic claims older than `before`; rows without a tool stay."""
    gone = (F.col("tool") != "") & F.col("superseded_by").isNotNull() & (F.col("recorded_at") < before)
    return claims.where(~F.coalesce(gone, F.lit(False)))


# ---------------------------------------------------------------- decisions


def decisions(rows: DataFrame, topic: str | None = None, since: int = 0, limit: int = 50) -> DataFrame:
    out = rows.where(F.col("topic") == topic) if topic else rows
    out = out.where(F.col("recorded_at") >= since) if since > 0 else out
    return out.orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit)


def link_superseded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """superseded_by: the next decision of the same keys."""
    w = Window.partitionBy(*keys).orderBy("recorded_at", "id")
    return rows.withColumn("superseded_by", F.lead("id").over(w))


def supersede(rows: DataFrame, id: int, new_id: int, choice: str, reasoning: str, now: int) -> DataFrame:
    """A new decision on the old one's topic, linked from it; refs and truth change are not carried over.

    Nothing changes if the old decision is missing or already superseded.
    """
    old = rows.where((F.col("id") == id) & F.col("superseded_by").isNull())
    fresh = old.select("topic").withColumns({"id": F.lit(new_id), "choice": F.lit(choice), "reasoning": F.lit(reasoning), "recorded_at": F.lit(now), "superseded_by": F.lit(None).cast("bigint")})
    linked = rows.withColumn("superseded_by", F.when((F.col("id") == id) & F.col("superseded_by").isNull(), F.lit(new_id)).otherwise(F.col("superseded_by")))
    return linked.unionByName(fresh, allowMissingColumns=True)


def stale_decisions(rows: DataFrame, refs: DataFrame, existing: DataFrame, limit: int = 0) -> DataFrame:
    """Decisions some of whose references no longer exist, with those, in their order.

    refs: (id, pos, ref); existing: (ref). Rows are limited before the test, as the list that is checked is.
    """
    top = rows.orderBy(F.desc("recorded_at"), F.desc("id")).limit(schema.clamp(limit, schema.STALE_ROWS)).select("id", "topic", "recorded_at")
    missing = refs.join(top.select("id"), "id", "left_semi").join(existing.select("ref").distinct(), "ref", "left_anti")
    listed = missing.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]), ",").alias("missing"), F.count("*").alias("n_missing"))
    return top.join(listed, "id")


def truth_changes(rows: DataFrame, scope: str | None = None, since: int = 0, limit: int = schema.HISTORY_ROWS) -> DataFrame:
    """Decisions with a truth change, oldest first; the limit comes after the scope."""
    out = rows.where("truth_change IS NOT NULL")
    out = out.where(F.col("recorded_at") >= since) if since > 0 else out
    out = out.where(F.col("truth_change.scope") == scope) if scope else out
    return out.orderBy("recorded_at", "id").limit(limit)


def truth_history(rows: DataFrame, path: str, limit: int = schema.HISTORY_ROWS) -> DataFrame:
    return rows.where("truth_change IS NOT NULL").where(F.array_contains("truth_change.files", path)).orderBy("recorded_at", "id").limit(limit)


def truth_story(rows: DataFrame) -> DataFrame:
    """(scope, n, n_trivial, first, last) of truth changes, by scope."""
    return rows.where("truth_change IS NOT NULL").groupBy(F.col("truth_change.scope").alias("scope")).agg(
        F.count("*").alias("n"), F.count_if("truth_change.trivial").alias("n_trivial"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last")
    )


def story_lines(rows: DataFrame, style: str = "markdown", include_trivial: bool = True) -> DataFrame:
    """(id, value): a line for each truth change, as markdown, plain (tab-separated) or json; without trivial ones if so asked.

    rows that are left out are counted by collapsed().
    """
    c = F.col("truth_change")
    kept = rows.where("truth_change IS NOT NULL")
    kept = kept if include_trivial else kept.where(~F.coalesce(c["trivial"], F.lit(False)))
    if style == "json":
        return kept.select("id", F.to_json(F.struct("id", "topic", "choice", "recorded_at", "truth_change")).alias("value"))
    if style == "plain":
        flat = F.translate(F.coalesce(c["motivated_by"], F.lit("")), "\t\n", "  ")
        when = F.date_format(F.timestamp_seconds("recorded_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return kept.select("id", F.concat_ws("\t", when, F.concat(F.lit("#"), F.col("id").cast("string")), F.concat(F.coalesce(F.nullif(c["scope"], F.lit("")), F.lit("?")), F.when(c["trivial"], " TRIVIAL").otherwise("")), "topic", flat).alias("value"))
    if style != "markdown":
        raise ValueError(f"no style {style!r}")
    day = F.date_format(F.timestamp_seconds("recorded_at"), "yyyy-MM-dd")
    files = F.coalesce(F.array_join(c["files"], ", "), F.lit(""))
    tail = F.concat_ws("; ", F.when(files != "", F.concat(F.lit("files: "), files)), F.when(c["supersedes"].isNotNull(), F.concat(F.lit("replaces #"), c["supersedes"].cast("string"))), F.when(c["trivial"], F.concat(F.lit("trivial: "), F.coalesce(c["trivial_reason"], F.lit("")))))
    line = F.concat(F.lit("- "), day, F.lit(" ["), c["scope"], F.lit("] "), F.col("topic"), F.lit(": "), F.col("choice"), F.when(tail != "", F.concat(F.lit(" ("), tail, F.lit(")"))).otherwise(""))
    return kept.select("id", line.alias("value"))


def collapsed(rows: DataFrame) -> DataFrame:
    """One row: how many trivial truth changes a story leaves out."""
    return rows.where("truth_change.trivial").agg(F.count("*").alias("collapsed_trivial"))


def decision_lines(rows: DataFrame, width: int = 80) -> DataFrame:
    """(id, value): a line for each decision, its reasoning cut to `width` characters."""
    mark = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit(" (superseded by #"), F.col("superseded_by").cast("string"), F.lit(")"))).otherwise("")
    return rows.select("id", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" ["), "topic", F.lit("] "), "choice", F.lit(" — "), one_line(F.coalesce("reasoning", F.lit("")), width), mark).alias("value"))


def claim_lines(rows: DataFrame, now: int, width: int = 80) -> DataFrame:
    """(id, value): a line for each claim, with its age."""
    age = human_duration(F.lit(now) - F.col("recorded_at"))
    return rows.select("id", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.when(F.col("verified"), "ok").otherwise("unverified"), F.lit(" "), one_line(F.col("claim"), width), F.lit(" ("), age, F.lit(" ago)")).alias("value"))


def chain_heads(rows: DataFrame, key: str = "id", link: str = "superseded_by") -> DataFrame:
    """(id, head, depth): where each chain of links ends, however long. Each round doubles the distance, and is a table.

    Ids are distinct. A chain ends at an id that rows lacks. Links in a circle are an error.
    """
    now = materialize(rows.select(F.col(key).alias("id"), F.coalesce(link, key).alias("head"), F.when(F.col(link).isNull(), 0).otherwise(1).cast("long").alias("depth")), "links")
    before = None
    for _ in range(CHAIN_ROUNDS):
        total = now.agg(F.sum("depth")).first()[0]
        if total == before or not total:
            return now.withColumn("depth", F.col("depth").cast("int"))
        before = total
        far = now.where("depth > 0").select(F.col("id").alias("head"), F.col("head").alias("__h"), F.col("depth").alias("__d"))
        step = now.join(far, "head", "left").select("id", F.coalesce("__h", "head").alias("head"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"))
        step = materialize(step, "links")
        discard(now)
        now = step
    raise ValueError("links form a circle")


#: Rounds after which a chain would have 2 ** 40 links.
CHAIN_ROUNDS = 40


def session_summary(rows: DataFrame) -> DataFrame:
    """By session: failures, unverified claims, and files they touch."""
    flagged = rows.where("NOT verified")
    return flagged.groupBy("session_id").agg(
        F.count_if(F.col("vet_ok") == F.lit(False)).alias("n_failed"), F.count_if(F.col("vet_ok").isNull()).alias("n_unverified"), F.countDistinct("file_path").alias("n_files")
    )


def verdict_fold(rows: DataFrame, by: str, ordinal: str, verdict: str) -> DataFrame:
    """The first verdict by ordinal that is not a pass decides; ask counts as deny."""
    v = F.when(F.col(verdict) == "ask", "deny").otherwise(F.col(verdict))
    first = F.min_by(F.when(F.col(verdict) != "pass", v), F.when(F.col(verdict) != "pass", F.col(ordinal)))
    return rows.groupBy(by).agg(F.coalesce(first, F.lit("pass")).alias("verdict"))
