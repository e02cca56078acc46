"""The ledger as a stream: expiry by event-time timers, and pointers to the first later success, emitted as they change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of claims that can expire: a few thousand claims each where there are millions.
GROUPS = 1024
#: Groups that failures which their block leaves open are dealt to; each sees the first success of every block.
SHARDS = 16
#: Ids of a block, and rows of a task that are dealt together.
BLOCK = 1 << 18
CHUNK = 1 << 20


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk; a session that names another provider keeps its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key):
        spark.conf.set(key, _PROVIDER)


def _packed(*columns) -> tuple:
    """Columns of 64-bit numbers as bytes: a group's state is read and written whole, never number by number."""
    return tuple(np.asarray(c, dtype=np.int64).tobytes() for c in columns)


def _unpacked(*columns) -> list[np.ndarray]:
    return [np.frombuffer(c, dtype=np.int64).copy() for c in columns]


class _Expiry(StatefulProcessor):
    """A group of claims, by id: how long each lasts (-1 before it has come), since when, and whether it was told; one timer stands for the next end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claims", "ids binary, ttl binary, since binary, told binary, timer long")

    def _held(self):
        if not self.state.exists():
            return *(np.zeros(0, np.int64) for _ in range(4)), -1
        *columns, timer = self.state.get()
        return *_unpacked(*columns), int(timer)

    def _keep(self, ids, ttl, since, told, timer: int) -> None:
        ends = ((since + ttl) * 1000 + 1)[(ttl >= 0) & (told == 0)]
        due = int(ends.min()) if len(ends) else -1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.state.update((*_packed(ids, ttl, since, told), due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, *columns, timer = self._held()
        new = pd.concat(list(rows))
        ids = np.unique(np.concatenate([held, new["id"].to_numpy(np.int64)]))
        ttl, since, told = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for wide, narrow in zip((ttl, since, told), columns):
            wide[np.searchsorted(ids, held)] = narrow
        at = np.searchsorted(ids, new["id"].to_numpy(np.int64))
        newest, lasts = since.copy(), ttl.copy()
        np.maximum.at(newest, at, new["at"].to_numpy(np.int64))
        has = new["ttl"].notna().to_numpy()
        lasts[at[has]] = new["ttl"].to_numpy()[has].astype(np.int64)
        other = ((lasts >= 0) != (ttl >= 0)) | (lasts >= 0) & (newest + lasts != since + ttl)
        back = other & (told > 0)
        told[back] = 0
        self._keep(ids, lasts, newest, told, timer)
        if back.any():
            yield pd.DataFrame({"id": ids[back], "stale": False, "at": newest[back]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, ttl, since, told, _ = self._held()
        over = (ttl >= 0) & (told == 0) & ((since + ttl) * 1000 + 1 <= timerValues.getCurrentWatermarkInMs())
        told[over] = 1
        self._keep(ids, ttl, since, told, -1)
        yield pd.DataFrame({"id": ids[over], "stale": np.ones(over.sum(), bool), "at": (since + ttl)[over]})

    def close(self) -> None:
        pass


def expiry(claims: DataFrame, touches: DataFrame | None = None, delay: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(id, stale, at): a verified claim whose check runs out is stale once the watermark has passed its end; a later touch takes that back.

    claims: id, verified, recorded_at, last_checked, ttl (streams; others than verified ones with a ttl are left out);
    touches: id, at (seconds), in any order with the claims. delay: how late rows may come. The last row of an id says
    what it is. Claims are dealt by id to `groups` groups, each with one timer, as a group costs far more than a claim;
    the boundary itself is not stale, as in ledger.stale().
    """
    keep_state_on_disk(claims.sparkSession)
    rows = claims.where("verified AND ttl IS NOT NULL AND id IS NOT NULL").select("id", F.coalesce("last_checked", "recorded_at").alias("at"), "ttl")
    if touches is not None:
        rows = rows.unionByName(touches.where("id IS NOT NULL").select("id", "at", F.lit(None).cast("bigint").alias("ttl")))
    timed = rows.where("at IS NOT NULL").withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    dealt = timed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    return dealt.groupBy("group").transformWithStateInPandas(_Expiry(), "id long, stale boolean, at long", "Append", "EventTime")


class _Pointers(StatefulProcessor):
    """Open claims and successes of a group: those that claims which come late may still need.

    Parallel arrays: claims' ids, seconds and pointers (-1: none yet), by id; successes' ids and seconds, by id. A
    pointer is corrected while an earlier success may still come; what the watermark has passed is settled and goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "ids binary, at binary, by binary, done binary, done_at binary, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, at, by, done, done_at, timer = self._held()
        new = pd.concat(list(rows))
        success = new["success"].to_numpy(bool)
        new_ids, new_at = new["id"].to_numpy(np.int64), new["at"].to_numpy(np.int64)
        # the first row of a claim stays, and the last of a success
        ids, first = np.unique(np.concatenate([ids, new_ids[~success]]), return_index=True)
        at = np.concatenate([at, new_at[~success]])[first]
        by = np.concatenate([by, np.full((~success).sum(), -1)])[first]
        done, last = np.unique(np.concatenate([done, new_ids[success]])[::-1], return_index=True)
        done_at = np.concatenate([done_at, new_at[success]])[::-1][last]
        place = np.searchsorted(done, ids, side="right")
        has = place < len(done)
        found = np.full(len(ids), -1)
        found[has] = done[place[has]]
        better = has & ((by < 0) | (found < by))
        by[better] = found[better]
        self._keep(ids, at, by, done, done_at, timer)
        if better.any():
            yield pd.DataFrame({"id": ids[better], "superseded_by": by[better]})

    def _held(self):
        if not self.state.exists():
            return *(np.zeros(0, np.int64) for _ in range(5)), -1
        *columns, timer = self.state.get()
        return *_unpacked(*columns), int(timer)

    @staticmethod
    def _settled(at, by, done, done_at) -> np.ndarray:
        """By claim: when nothing can change it any more, should it have a pointer."""
        out, place = at.copy(), np.searchsorted(done, by)
        known = place < len(done)
        known[known] = done[place[known]] == by[known]
        out[known] = np.maximum(at[known], done_at[place[known]])
        return out

    def _keep(self, ids, at, by, done, done_at, timer: int) -> None:
        """Write the state; one timer stands for the next moment at which something in it is settled."""
        settled = np.concatenate([self._settled(at, by, done, done_at)[by >= 0], done_at])
        due = int(settled.min()) * 1000 + 1 if len(settled) else -1
        if due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        if len(ids) or len(done):
            self.state.update((*_packed(ids, at, by, done, done_at), due))
        elif self.state.exists():
            self.state.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, at, by, done, done_at, _ = self._held()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        stays = done_at >= now
        done, done_at = done[stays], done_at[stays]
        stays = (by < 0) | (self._settled(at, by, done, done_at) >= now)
        self._keep(ids[stays], at[stays], by[stays], done, done_at, -1)
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "superseded_by": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def _dealt(shards: int, block: int, chunk: int):
    """Rows (id, at, success, failure, file) to groups (file, part), for mapInArrow; file is null in a last row of each chunk, with its latest time.

    A block of ids, of a file and of all (file ''), is a group of its own: part >= 0. Beyond its block a claim can only
    need the first success of a later block, and only where its own block has none after it. So from each chunk of rows
    the groups beyond the blocks (part < 0) get no more than the first success of a block and the claims after its last one.
    """

    def lane(id_, at, success, file, codes, spread_over: int):
        """Near and far rows of one lane, as tuples of columns; codes number the files."""
        if not len(id_):
            return
        blocks = id_ // block
        known, place = np.unique(blocks, return_inverse=True)
        known, group = np.unique(codes * len(known) + place, return_inverse=True)
        least, most = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(least, group[success], id_[success])
        np.maximum.at(most, group[success], id_[success])
        first = np.flatnonzero(success & (id_ == least[group]))
        left = np.flatnonzero(~success & (id_ >= most[group]))
        yield id_, at, success, file, blocks
        yield id_[left], at[left], success[left], file.take(pa.array(left)), -1 - id_[left] % spread_over
        for k in range(spread_over):
            yield id_[first], at[first], success[first], file.take(pa.array(first)), np.full(len(first), -1 - k)

    def groups_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        id_, at, success, failure = (t.column(c).to_numpy() for c in ("id", "at", "success", "failure"))
        file = t.column("file").combine_chunks()
        success, failure = success.astype(bool), failure.astype(bool)
        any_ = np.flatnonzero(success | failure)
        own = np.flatnonzero(file.is_valid().to_numpy(zero_copy_only=False))
        named = file.take(pa.array(own))
        codes = named.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        everywhere = pa.array([""] * len(any_), pa.string())
        lanes = ((any_, everywhere, np.zeros(len(any_), np.int64), shards), (own, named, codes, 1))
        for rows, files, numbers, over in lanes:
            for i, s, ok, f, part in lane(id_[rows], at[rows], success[rows], files, numbers, over):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(ok), f, pa.array(part, pa.int64())], names=_DEALT)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([at.max()], pa.int64()), pa.array([False]), pa.nulls(1, pa.string()), pa.array([0], pa.int64())], names=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= chunk:
                yield from groups_of(held)
                held, count = [], 0
        if held:
            yield from groups_of(held)

    return run


_DEALT = ["id", "at", "success", "file", "part"]


def supersession(claims: DataFrame, delay: str = "0 seconds", shards: int = SHARDS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(id, superseded_by): a claim's pointer to the first later success, each time that a group finds one or an earlier one.

    claims: id, verified, vet_ok, file_path, recorded_at, as ledger.supersede_claims() has them; the least pointer of an
    id over the drained stream is that of the batch, whatever the order in which rows come within `delay`. Claims and
    successes are dealt by file, and explicit failures and successes of any file too, in blocks of ids (_dealt()); what
    a block may leave open goes to a group of its file, or to one of `shards` groups, each of which sees the first
    successes of all blocks. No group holds all failures or all successes. State holds claims without a pointer, and
    what may still be corrected. block: ids of a block; chunk: rows of a task that are dealt together.
    """
    keep_state_on_disk(claims.sparkSession)
    success = F.coalesce(F.col("verified") & F.col("vet_ok").isNotNull(), F.lit(False))
    failure = F.coalesce(~F.col("verified") & (F.col("vet_ok") == F.lit(False)), F.lit(False))
    file = F.when((F.col("file_path") != "") & (success | ~F.col("verified")), F.col("file_path"))
    rows = claims.where("id IS NOT NULL AND recorded_at IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("recorded_at").cast("long").alias("at"), success.alias("success"), failure.alias("failure"), file.alias("file"))
    dealt = rows.mapInArrow(_dealt(shards, block, chunk), "id long, at long, success boolean, file string, part long")
    timed = dealt.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", delay)
    # a condition on the time too stays above the watermark, which counts rows of no group as well
    kept = timed.where(F.when(F.col("ts").isNotNull(), F.col("file").isNotNull()))
    return kept.groupBy("file", "part").transformWithStateInPandas(_Pointers(), "id long, superseded_by long", "Append", "EventTime")
