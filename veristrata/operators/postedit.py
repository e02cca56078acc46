"""The flow after an edit: check the path, index the file, verify the project, record a claim, and let a success clear what it clears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import extract as ex
from ..functions.text import contained, cut_bytes, first_error, without_noise
from ..sources.trees import language_of
from . import index


def claims_of(events: DataFrame, verb: str, ran: bool, passed: bool | None, output: str, exit_error: str | None, now: int, noise: tuple[str, ...] = ()) -> DataFrame:
    """A claim for each edit: events (id, session_id, tool, path, index_error). The verifier ran once for all of them.

    A claim is verified if the file was indexed and the verifier passed or did not run.
    """
    result, told = ("skipped", F.lit("")) if not ran else ("ok" if passed else "failed", without_noise(F.lit(output), noise))
    label = F.lit(f"{verb}={result}" if ran else f"{verb}=skipped (no module)")
    indexed = F.col("index_error").isNull()
    claim = F.concat_ws("; ", F.concat(F.lit("tool="), F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("edit")), F.lit(" file="), F.col("path")), F.when(indexed, "index=ok").otherwise("index=failed"), label)
    lines = [F.concat(F.lit("file: "), F.col("path")), F.when(~indexed, F.concat(F.lit("index error: "), F.col("index_error"))), F.lit(f"{verb}: {result}")]
    if ran and not passed and exit_error:
        lines.append(F.lit(f"exit: {exit_error}"))
    if ran:
        lines.append(F.nullif(told, F.lit("")))
    failed = F.lit(ran and not passed)
    return events.select(
        "id", "session_id", claim.alias("claim"), cut_bytes(F.concat_ws("\n", *lines), schema.EVIDENCE_BYTES, "\n…(truncated)").alias("evidence"), (indexed & F.lit(not ran or bool(passed))).alias("verified"), F.lit(now).cast("bigint").alias("recorded_at"), F.col("path").alias("file_path"),
        F.lit(None).cast("bigint").alias("superseded_by"), "tool", indexed.alias("index_ok"), F.lit(passed if ran else None).cast("boolean").alias("vet_ok"), F.when(failed, first_error(told, F.lit(exit_error).cast("string"), schema.SUMMARY_BYTES)).otherwise("").alias("vet_error_summary"),
        F.lit(None).cast("bigint").alias("last_checked"), F.lit(None).cast("bigint").alias("ttl"),
    )


def message(path: Column, index_error: Column, verb: str, ran: bool, passed: bool | None, error: Column) -> Column:
    """What an operator is told; null after a clean run."""
    bad_index = F.when(index_error.isNotNull(), F.concat(F.lit("could not index "), path, F.lit(": "), index_error))
    bad_run = F.when(F.lit(bool(ran and not passed)), F.concat(F.lit(f"{verb} failed after an edit of "), path, F.lit(": "), error))
    return F.nullif(F.concat_ws("; ", bad_index, bad_run), F.lit(""))


def edited(edits: DataFrame, root: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of files, rows of symbols, events) of these edits: what takes the place of all rows of the files' paths.

    edits: id, session_id, tool, path, content (the file as it is now; null if the edit did not land). Paths out of root and
    edits that did not land give no event. Of several edits of one path in a batch the last one (by id) is indexed;
    files of no known kind are not indexed, which is no error. A file that does not parse has a row, with its new hash,
    and no symbols: so it is not parsed again until it changes, and no symbol of its old text stays. events are the
    edits with path (relative to root) and index_error.
    """
    base = root.rstrip("/") + "/"
    inside = edits.withColumn("__abs", contained(F.col("path"), root)).where("__abs IS NOT NULL AND content IS NOT NULL")
    inside = inside.withColumn("path", F.expr(f"substring(__abs, {len(base) + 1})")).drop("__abs")
    last = inside.groupBy("path").agg(F.max_by("content", "id").alias("text")).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    parsed = ex.extract(last.select("path", "language", "text"))
    errors = parsed.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("index_error"))
    rows = last.select("path", F.sha2("text", 256).alias("hash"), "language", F.octet_length("text").cast("bigint").alias("size_bytes"), F.lit(now).cast("bigint").alias("indexed_at"))
    return rows, symbols_of(parsed.join(errors.select("path"), "path", "left_anti")), inside.join(errors, "path", "left").drop("content")


def symbols_of(parsed: DataFrame) -> DataFrame:
    """Rows of the symbol table from extracted ones, each with its parent; rows with an error are left out."""
    fresh = parsed.where("error IS NULL").select(
        F.xxhash64("path", "ord").alias("id"), F.col("path").alias("file_path"), "name", "qualified_name", "kind", "signature", "start_line", "end_line", "exported"
    )
    return index.with_parents(fresh).select([c.split()[0] for c in schema.SYMBOLS.split(", ")])


def apply_edits(edits: DataFrame, files: DataFrame, symbols: DataFrame, root: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, events): both tables after these edits, and edited()'s events."""
    rows, fresh, events = edited(edits, root, now)
    return index.upsert_files(files, rows).select(files.columns), index.replace_symbols(symbols, fresh.select(symbols.columns), rows), events
