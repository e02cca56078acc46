"""The file and symbol index: lookups, counts, and index maintenance as functions from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import contains_ignoring_case, glob_regex
from ..sources.trees import query_language_of


def get_file(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def find_symbols_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Exact and case-sensitive; by file, line and id."""
    return symbols.where(F.col("name") == name).orderBy("file_path", "start_line", "id").limit(schema.STORE_ROWS)


def find_symbols_by_query(symbols: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Substring of name or qualified name, ignoring ASCII case. limit: 0 is the store's cap, negative 50."""
    n = schema.STORE_ROWS if limit == 0 else 50 if limit < 0 else min(limit, schema.STORE_ROWS)
    hit = contains_ignoring_case(F.col("name"), query) | contains_ignoring_case(F.col("qualified_name"), query)
    return symbols.where(hit).orderBy("name", "file_path", "start_line", "id").limit(n)


def _matching(symbols: DataFrame, kind: str | None, language: str | None = None, exported: bool | None = None) -> DataFrame:
    """language: that of the symbol's path, as queries see it."""
    out = symbols.where(F.col("kind") == kind) if kind else symbols
    out = out.where(query_language_of(F.col("file_path")) == language.lower()) if language else out
    return out if exported is None else out.where(F.col("exported") == exported)


def _checked(query: str, what: str) -> None:
    if len(query.encode()) > schema.QUERY_BYTES:
        raise ValueError(f"{what} exceeds {schema.QUERY_BYTES} bytes")


def find_symbol(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 0, language: str | None = None, exported: bool | None = None) -> DataFrame:
    """The limit applies before kind, language and exported, so a result can be short; then the tool's own cap."""
    if not query:
        raise ValueError("the query must not be empty")
    _checked(query, "query")
    return _matching(find_symbols_by_query(symbols, query, limit), kind, language, exported).limit(schema.SYMBOL_ROWS)


def verify_symbol(symbols: DataFrame, name: str, kind: str | None = None, language: str | None = None) -> DataFrame:
    """Exact matches (exists true), or, only where there are none, up to five near names as suggestions."""
    _checked(name, "name")
    hits = _matching(find_symbols_by_name(symbols, name), kind, language).withColumn("exists", F.lit(True))
    near = _matching(find_symbols_by_query(symbols, name, schema.SUGGESTIONS), kind, language).withColumn("exists", F.lit(False))
    found = hits.limit(1).select(F.lit(True).alias("exists"))
    return hits.unionByName(near.join(found.select((~F.col("exists")).alias("exists")), "exists", "left_anti"))


def verify_qualified(symbols: DataFrame, qualified: str) -> DataFrame:
    bare = qualified.rsplit(".", 1)[-1]
    return find_symbols_by_name(symbols, bare).where(F.col("qualified_name") == qualified)


def all_files(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def list_files(files: DataFrame, pattern: str | None = None, language: str | None = None, limit: int = 0) -> DataFrame:
    out = files
    if pattern:
        out = out.where(F.col("path").rlike(glob_regex(pattern)))
    if language:
        out = out.where(F.col("language") == language)
    return out.orderBy("path").limit(schema.clamp(limit, schema.LIST_FILES)).select("path", "language", "size_bytes")


def recent_changes(files: DataFrame, since: int, limit: int = 0) -> DataFrame:
    out = files.where(F.col("indexed_at") >= since).orderBy(F.desc("indexed_at"), "path")
    return out.limit(schema.clamp(limit, schema.RECENT)).select("path", "language", "size_bytes", "indexed_at")


def symbol_counts_by_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file_path").agg(F.count("*").alias("n_symbols"))


def language_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, symbols and the newest index time by language. Symbols are counted by file before the join."""
    joined = files.join(symbol_counts_by_file(symbols), files.path == F.col("file_path"), "left")
    return joined.groupBy("language").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_symbols"), F.lit(0)).cast("long").alias("n_symbols"), F.max("indexed_at").alias("last_indexed"))


def empty_files(files: DataFrame, symbols: DataFrame, languages: tuple[str, ...] = ("bash", "nix"), size: int = 512) -> DataFrame:
    """Files over `size` bytes without symbols, but for languages that seldom have any."""
    rest = files.where((F.col("size_bytes") > size) & ~F.col("language").isin(*languages))
    return rest.join(symbols.select("file_path").distinct(), rest.path == F.col("file_path"), "left_anti").select("path", "language", "size_bytes")


def stale_files(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Indexed paths that the scan of the disk no longer has."""
    return files.join(scan.select("path").distinct(), "path", "left_anti").select("path")


def suspects(files: DataFrame, symbols: DataFrame, scan: DataFrame) -> DataFrame:
    """empty_files() without stale ones: a file that is gone is no sign of a failed parse."""
    return empty_files(files, symbols).join(stale_files(files, scan), "path", "left_anti")


def ledger_counts(decisions: DataFrame, unverified: DataFrame, stale: DataFrame) -> DataFrame:
    """(n_decisions, n_stale_decisions, n_unverified) as the lists that they count are capped: DECISION_ROWS, STALE_ROWS, STORE_ROWS."""
    parts = [decisions.limit(schema.DECISION_ROWS[1]).agg(F.count("*").alias("n_decisions")), stale.agg(F.count("*").alias("n_stale_decisions")), unverified.limit(schema.STORE_ROWS).agg(F.count("*").alias("n_unverified"))]
    out = parts[0].withColumn("one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def with_parents(symbols: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """symbols (id, file_path, qualified_name, ...) with parent_id: the symbol of the same file, of `among` if given, whose qualified name is theirs without its last part."""
    outer = F.regexp_replace("qualified_name", r"\.[^.]*$", "")
    parents = (symbols if among is None else among).groupBy(F.col("file_path").alias("__f"), F.col("qualified_name").alias("__q")).agg(F.min("id").alias("__p"))
    rows = symbols.drop("parent_id").withColumn("__o", F.when(outer != F.col("qualified_name"), outer))
    out = rows.join(parents, (F.col("file_path") == F.col("__f")) & (F.col("__o") == F.col("__q")), "left")
    return out.withColumn("parent_id", F.col("__p")).drop("__f", "__q", "__o", "__p")


# ---------------------------------------------------------------- maintenance


def upsert_files(files: DataFrame, delta: DataFrame) -> DataFrame:
    """Insert or replace by path."""
    return files.join(delta, "path", "left_anti").unionByName(delta)


def replace_symbols(symbols: DataFrame, delta: DataFrame, paths: DataFrame) -> DataFrame:
    """All symbols of `paths` go, those of delta come; a file without symbols in delta ends up with none."""
    return symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(symbols.columns).unionByName(delta)


def delete_files(files: DataFrame, symbols: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these paths; symbols go with their file."""
    gone = paths.select("path").distinct()
    return files.join(gone, "path", "left_anti"), symbols.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(symbols.columns)


def prune(files: DataFrame, scan: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Rows that the scan of the disk still has and that lie in no skipped folder."""
    kept = files.join(scan.select("path").distinct(), "path", "left_semi")
    return kept.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skipped)))) if skipped else kept


def changed(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files whose hash the index does not have; the rest need no parsing."""
    known = files.select("path", F.col("hash").alias("__hash"))
    return scan.join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("__hash"))).drop("__hash")
