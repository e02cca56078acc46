"""Structured Streaming forms of the event pipeline: decoding, guards, dedup, session summaries, single-use tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import guard
from ..sources.trees import decode_events
from ..store import Replayed

TOKEN_SECONDS = 300


def read_envelopes(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Decoded events of a folder of JSON lines; malformed ones are marked, not lost."""
    return decode_events(spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder))


def pre_edit_verdicts(events: DataFrame, path_filters, content_filters) -> DataFrame:
    """One verdict per event, statelessly; a malformed event is denied."""
    out = guard.pre_edit(events.withColumn("path", F.coalesce("path", F.lit(""))), path_filters, content_filters)
    return out.withColumn("decision", F.when(F.col("malformed"), "deny").otherwise(F.col("decision")))


def unchanged_dropped(files: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (path, hash) once within the watermark: files (path, hash, ts) that did not change are not indexed again."""
    return files.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["path", "hash"])


def session_totals(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """By session, whatever the order of events: failures, unverified claims, and the number of events.

    Sums only, so the state of a session is one row.
    """
    return events.withWatermark("ts", watermark).groupBy("session_id").agg(
        F.count_if(F.col("vet_ok") == F.lit(False)).alias("n_failed"), F.count_if(~F.col("verified")).alias("n_unverified"), F.count("*").alias("n_events")
    )


def stop_reports(events: DataFrame, idle: str = "24 hours") -> DataFrame:
    """A session's unverified and failed counts, emitted when its stop event comes; then its state is dropped.

    events: session_id, event (claim or stop), verified, vet_ok, ts. State holds two numbers per session; that of a session
    that never stops goes when the watermark has passed `idle` since its last event, without a report.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        unverified, failed = state.get if state.exists else (0, 0)
        stopped, last = False, state.getCurrentWatermarkMs()
        for f in frames:
            last = max([last, *(int(t.timestamp() * 1000) for t in f["ts"].dropna())])
            claims = f[f["event"] != "stop"]
            unverified += int((~claims["verified"].fillna(False).astype(bool)).sum())
            failed += int((claims["vet_ok"] == False).sum())  # noqa: E712
            stopped = stopped or bool((f["event"] == "stop").any())
        if stopped:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], unverified, failed)], columns=["session_id", "n_unverified", "n_failed"])
        else:
            state.update((unverified, failed))
            state.setTimeoutTimestamp(last + idle_ms)

    rows = events.withWatermark("ts", "10 minutes")
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id string, n_unverified long, n_failed long", "u long, f long", "append", GroupStateTimeout.EventTimeTimeout)


def tokens(events: DataFrame, seconds: int = TOKEN_SECONDS) -> DataFrame:
    """Which edits a token covers. events: project, path, kind (token or edit), ts.

    A token is for one path, lasts `seconds`, and is used up by the first edit that it covers; a newer one replaces it.
    State is a token that still lasts; it goes once the watermark has passed its end, and nothing is kept for other paths.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        issued = state.get[0] if state.exists else -1
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "kind"], ascending=[True, False])
        for ts, kind in zip(rows["ts"].map(lambda t: int(t.timestamp())), rows["kind"]):
            if kind == "token":
                issued = ts
            else:
                ok = issued >= 0 and ts - issued <= seconds
                out.append((*key, ts, ok))
                issued = -1
        end = (issued + seconds + 1) * 1000
        if issued >= 0 and end > state.getCurrentWatermarkMs():
            state.update((issued,))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["project", "path", "at", "covered"])

    rows = events.withWatermark("ts", "10 minutes")
    return rows.groupBy("project", "path").applyInPandasWithState(step, "project string, path string, at long, covered boolean", "issued long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drain what is there into files and return them as a table; nothing passes through the driver. Append mode."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def drain_last(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Drain what is there in complete mode: each micro-batch writes the whole result to files of its own, the last one is returned."""
    spark, seen = stream.sparkSession, []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        seen[:] = [epoch]

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/epoch={seen[0]}") if seen else spark.createDataFrame([], stream.schema)


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drain what is there into an in-memory table of the driver, for small results as in tests; drain() writes files."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def post_edits(engine, root: str, clock: Callable[[], int], verify: Callable[[str], tuple] | None = None, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that indexes a micro-batch's edits, verifies once, and records their claims.

    Batches: id, session_id, tool, path, content. Exactly once: the store keeps each stream's last epoch in the pointer
    that shows the batch's rows, so a batch that is run again after a failure changes nothing, whatever other streams
    did meanwhile. stream: its name; by default the query's id, which a checkpoint keeps over restarts.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        name = stream or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not name:
            raise ValueError("a stream outside a query needs a name")
        if engine.snapshots.version().epochs.get(name, -1) >= epoch:
            return
        try:
            engine.post_edit(batch, root, clock(), verify, epoch=(name, epoch))
        except Replayed:
            pass

    return run


def post_edit_sink(load: Callable[[], tuple], apply: Callable[[DataFrame, tuple], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reloads its truth files for every micro-batch and keeps the last good ones if that fails."""
    held: list = []

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            held[:] = [load()]
        except Exception:
            if not held:
                raise
        apply(batch, held[0])

    return run
