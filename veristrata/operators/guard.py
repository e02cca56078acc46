"""Guards of edit events: path and content filters, tiers, exemptions, and references to symbols that do not exist."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_view, contained, matches_target, segment_glob_regex


def path_filter(path: Column, filters: list[tuple[str, str, list[str]]]) -> Column:
    """The first filter (name, pattern, forbidden) that rejects a path, else null: its group 1 is forbidden, ignoring case; an empty list forbids any match."""
    out = None
    for name, pattern, forbidden in filters:
        hit = path.rlike(pattern)
        if forbidden:
            hit = hit & F.lower(F.regexp_extract(path, pattern, 1)).isin(*[f.lower() for f in forbidden])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def content_filter(text: Column, filters: list[tuple[str, str, str]]) -> Column:
    """The first filter (name, pattern, disclosure) whose pattern occurs without its disclosure, which is sought ignoring case."""
    out = None
    for name, pattern, disclosure in filters:
        hit = text.rlike(pattern) & ~F.contains(F.lower(text), F.lit(disclosure.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def tier(path: Column, policy: list[tuple[str, str, str]]) -> Column:
    """struct(scope, tier) of the first entry (match, scope, tier): equal, under a folder (match ends in a slash), or contained."""
    out = None
    for match, scope, level in policy:
        hit = (path == match) | (F.startswith(path, F.lit(match)) if match.endswith("/") else F.contains(path, F.lit(match)))
        value = F.struct(F.lit(scope).alias("scope"), F.lit(level).alias("tier"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if out is not None else F.lit(None).cast("struct<scope:string,tier:string>")


def exempt(path: Column, folder: str, globs: list[str]) -> Column:
    out = F.startswith(path, F.lit(folder.rstrip("/") + "/"))
    for g in globs:
        out = out | path.rlike(segment_glob_regex(g))
    return out


def command_mutates(command: Column) -> Column:
    """A shell command that redirects, edits in place, or tees."""
    return F.contains(command, F.lit(">")) | (F.contains(command, F.lit("sed")) & F.contains(command, F.lit("-i"))) | F.contains(command, F.lit("tee "))


def in_protected_folder(path: Column, folder: str) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s) == folder.lower())


def pre_edit(events: DataFrame, path_filters, content_filters, trusted: Column | None = None, forbidden: Column | None = None) -> DataFrame:
    """events (path, text) with decision and reason: path filters, then content filters, then forbidden claims; denied only where trusted."""
    reason = F.coalesce(path_filter(F.col("path"), path_filters), content_filter(F.col("text"), content_filters), forbidden if forbidden is not None else F.lit(None).cast("string"))
    deny = reason.isNotNull() & (trusted if trusted is not None else F.lit(True))
    return events.withColumn("reason", reason).withColumn("decision", F.when(deny, "deny").otherwise("pass"))


def scanned_text(tool: Column, text: Column, command: Column) -> Column:
    """What of an edit is searched for claims: its text, or the command of a shell call that writes files; else null."""
    given = F.nullif(text, F.lit(""))
    return F.coalesce(given, F.when((tool == "Bash") & command_mutates(command), F.nullif(command, F.lit(""))))


# The wording of denials.
DENY_PATH = "Path \"{path}\" is forbidden by path_filters[{n}]: {reason}. Use an override to bypass for a single edit."
DENY_CONTENT = "Content matches content_filters[{n}] without the required text {required}."
DENY_CLAIM = "Forbidden claim \"{text}\" at line {line} col {col} matches rule {rule} in do-not-claim.md{reason}.{tail} Rewrite to avoid the claim or update the rule if it is wrong."
REASON_CHARS = 200


def _worded(pattern: str, **parts: Column) -> Column:
    """A wording with its {names} replaced by columns."""
    out = [p if i % 2 == 0 else parts[p] for i, p in enumerate(re.split(r"[{}]", pattern))]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in out])


def guard_edits(events: DataFrame, claims: DataFrame, rules: DataFrame, path_filters, content_filters, root: str, targets: list[str] = (), truth_folder: str = "truth", exempt_globs: list[str] = (), trusted: bool = True, overrides: list[str] = ()) -> DataFrame:
    """(id, decision, reason) of edits: path filters, then content filters, then forbidden claims.

    events: id, tool, path, text, command; claims: detect()'s of scanned_text() by id; rules: ord, reason. Claims count only in
    edits without a path, or of a path inside root that a target fits and that is not exempt. A path of `overrides`
    (relative to root) passes everything; where the project is not trusted nothing is denied, and the reason says what would be.
    """
    inside = contained(F.col("path"), root)
    rel = F.when(inside.isNotNull(), F.expr("substring(__abs, %d)" % (len("/" + root.strip("/")) + 2))).otherwise(F.col("path"))
    e = events.withColumn("__abs", inside).withColumn("__rel", rel).withColumn("__scan", scanned_text(F.col("tool"), F.col("text"), F.col("command")))
    number = lambda found, filters: F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f[0], str(i))]), found) if filters else F.lit(None).cast("string")
    by_path, by_content = path_filter(F.col("__rel"), path_filters), content_filter(F.coalesce("text", F.lit("")), content_filters)
    e = e.withColumn("__path", by_path).withColumn("__content", by_content)
    no_path = F.coalesce(F.col("path"), F.lit("")) == ""
    free = exempt(F.col("__rel"), truth_folder, list(exempt_globs))
    guarded = no_path | (F.col("__abs").isNotNull() & matches_target(F.col("__abs"), list(targets)) & ~F.coalesce(free, F.lit(False)))
    first = claims.groupBy("id").agg(
        F.min_by(F.struct("start", "text", "path"), F.when(F.col("verdict") == "forbidden", F.struct("start", "end"))).alias("hit"), F.count_if(F.col("verdict") == "forbidden").alias("n_forbidden"), F.count("*").alias("n_claims")
    )
    e = e.join(first, "id", "left").join(rules.select(F.concat(F.lit("#"), F.col("ord").cast("string")).alias("__rule"), F.col("reason").alias("__why")), F.col("hit.path") == F.col("__rule"), "left")
    before = F.substring(byte_view(F.col("__scan")), F.lit(1), F.col("hit.start"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    col = F.length(F.substring_index(before, "\n", -1)) + 1
    why = F.trim(F.coalesce("__why", F.lit("")))
    why = F.when(F.length(why) > REASON_CHARS, F.concat(F.substring(why, 1, REASON_CHARS - 1), F.lit("…"))).otherwise(why)
    claim = _worded(
        DENY_CLAIM, text=F.col("hit.text"), line=line.cast("string"), col=col.cast("string"), rule=F.col("hit.path"), reason=F.when(why != "", F.concat(F.lit(" — "), why)).otherwise(""),
        tail=F.when(F.col("n_claims") > 1, F.concat(F.lit(" (1 of "), F.col("n_claims").cast("string"), F.lit(" forbidden findings in this edit)"))).otherwise(""),
    )
    reason = (
        F.when(F.col("__path").isNotNull(), _worded(DENY_PATH, path=F.col("__rel"), n=number(F.col("__path"), path_filters), reason=F.col("__path")))
        .when(F.col("__content").isNotNull(), _worded(DENY_CONTENT, n=number(F.col("__content"), content_filters), required=F.col("__content")))
        .when((F.col("n_forbidden") > 0) & guarded, claim)
    )
    passed = F.col("__rel").isin(*overrides) if overrides else F.lit(False)
    e = e.withColumn("reason", F.when(~F.coalesce(passed, F.lit(False)), reason))
    return e.select("id", F.when(F.col("reason").isNotNull() & F.lit(trusted), "deny").otherwise("pass").alias("decision"), "reason")


def audited(events: DataFrame, claims: DataFrame, root: str, targets: list[str] = (), truth_folder: str = "truth", exempt_globs: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(findings, tree edits) of edits that landed: events: id, session_id, tool, path, timestamp, recorded_at.

    Findings are unverified and forbidden claims of edits inside root that a target fits; an edit of the truth folder
    itself is a tree edit instead, and other exempt paths are neither.
    """
    e = events.withColumn("__abs", contained(F.col("path"), root)).where("__abs IS NOT NULL")
    e = e.withColumn("path", F.expr("substring(__abs, %d)" % (len("/" + root.strip("/")) + 2)))
    own = F.startswith("path", F.lit(truth_folder.strip("/") + "/"))
    rest = e.where(~own).where(matches_target(F.col("__abs"), list(targets))).where(~exempt(F.col("path"), truth_folder, list(exempt_globs)))
    kept = claims.where(F.col("verdict").isin("unverified", "forbidden"))
    item = F.struct("start", "end", "category", "verdict", "text", F.col("path").alias("path"))
    found = kept.groupBy("id").agg(F.count_if(F.col("verdict") == "forbidden").alias("forbidden"), F.count_if(F.col("verdict") == "unverified").alias("unverified"), F.sort_array(F.collect_list(item)).alias("claims"))
    return rest.drop("__abs").join(found, "id"), e.where(own).drop("__abs")


def imports_of(snippets: DataFrame, source: str = "text") -> DataFrame:
    """(id, alias, path) of import lines in Go text: an explicit alias, else the path's last segment but for a version."""
    line = F.explode(F.regexp_extract_all(source, F.lit(r'(?m)(?:^|import)\s*((?:[A-Za-z_]\w*\s+)?"[^"\n]+")\s*$'), 1))
    rows = snippets.select("id", line.alias("i"))
    path = F.regexp_extract("i", '"([^"]+)"', 1)
    alias = F.regexp_extract("i", r'^([A-Za-z_]\w*)\s+"', 1)
    default = F.regexp_extract(path, r"([^/]+?)(?:/v[0-9]+)?$", 1)
    return rows.select("id", F.when(alias != "", alias).otherwise(default).alias("alias"), path.alias("path"))


def fabricated_references(snippets: DataFrame, imports: DataFrame, symbols: DataFrame, tracked: str) -> DataFrame:
    """(id, missing): selectors on tracked imports whose bare name no symbol has, distinct and sorted.

    imports: (id, alias, path, priority) of snippet, file and sibling files; the least priority wins for an alias.
    String literals and comments are taken out first; selectors are found by pattern.
    """
    bare = F.regexp_replace("text", r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|//[^\n]*', "")
    refs = snippets.select("id", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![\w.])([A-Za-z_]\w*\.[A-Za-z_]\w*)"), 1))).alias("ref"))
    refs = refs.select("id", F.split("ref", r"\.")[0].alias("alias"), F.split("ref", r"\.")[1].alias("name"))
    chosen = imports.groupBy("id", "alias").agg(F.min_by("path", "priority").alias("path")).where(F.startswith("path", F.lit(tracked)))
    missing = refs.join(chosen, ["id", "alias"]).join(symbols.select("name").distinct(), "name", "left_anti")
    return missing.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(".", "alias", "name"))), ",").alias("missing"))
