import json

import pytest

from veristrata.streaming import events as st


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))


def test_pre_edit_stream_denies_malformed(spark, tmp_path):
    write(tmp_path, "a.jsonl", [{"session_id": "s", "tool_input": {"file_path": "src/fr/x", "new_string": "y"}}, {"session_id": "s", "tool_input": {"file_path": "ok", "content": "y"}}, "{broken"])
    out = st.run_available(st.pre_edit_verdicts(st.read_envelopes(spark, str(tmp_path)), [("l", "src/([a-z]+)/", ["fr"])], []), "verdicts")
    assert sorted(r.decision for r in out.collect()) == ["deny", "deny", "pass"]


def test_stop_reports(spark, tmp_path):
    at = {"ts": "2024-01-01T00:00:00Z"}
    write(tmp_path, "a.jsonl", [{"session_id": "s", "event": "claim", "verified": False, "vet_ok": False} | at, {"session_id": "s", "event": "claim", "verified": False} | at, {"session_id": "t", "event": "claim", "verified": False} | at, {"session_id": "s", "event": "stop"} | at])
    raw = spark.readStream.schema("session_id string, event string, verified boolean, vet_ok boolean, ts timestamp").json(str(tmp_path))
    out = st.run_available(st.stop_reports(raw), "stops").collect()
    assert [(r.session_id, r.n_failed) for r in out] == [("s", 1)]


def test_tokens_are_used_once_and_expire(spark, tmp_path):
    t = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    write(tmp_path, "a.jsonl", [{"project": "p", "path": "a", "kind": k, "ts": t(s)} for k, s in (("token", 0), ("edit", 10), ("edit", 20), ("token", 30), ("edit", 900))])
    raw = spark.readStream.schema("project string, path string, kind string, ts timestamp").json(str(tmp_path))
    out = st.run_available(st.tokens(raw), "tokens").orderBy("at").collect()
    assert [r.covered for r in out] == [True, False, False]


def test_state_of_idle_sessions_goes(spark, tmp_path):
    """A session's counts are dropped once the watermark has passed; a later stop then reports what came after."""
    kind = "session_id string, event string, verified boolean, vet_ok boolean, ts timestamp"
    source = tmp_path / "in"
    source.mkdir()
    stream = lambda: st.stop_reports(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(source)), "1 hour")
    day = lambda d, h=0: f"2024-01-{d:02d}T{h:02d}:00:00Z"
    for name, rows in (("1", [("s", "claim", day(1))]), ("2", [("t", "claim", day(3))]), ("3", [("t", "claim", day(3, 1))]), ("4", [("s", "claim", day(4)), ("s", "stop", day(4))])):
        write(source, name, [{"session_id": s, "event": e, "verified": False, "ts": ts} for s, e, ts in rows])
        out = st.drain(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert [(r.session_id, r.n_unverified) for r in out.collect()] == [("s", 1)]


def test_unchanged_files_go_once(spark, tmp_path):
    write(tmp_path, "a.jsonl", [{"path": p, "hash": h, "ts": "2024-01-01T00:00:00Z"} for p, h in (("a", "1"), ("a", "1"), ("a", "2"))])
    raw = spark.readStream.schema("path string, hash string, ts timestamp").json(str(tmp_path))
    assert sorted(r.hash for r in st.run_available(st.unchanged_dropped(raw), "unchanged").collect()) == ["1", "2"]


def test_post_edit_batches_are_recorded_once(spark, tmp_path):
    """A replayed batch changes nothing; another stream's first batch is a batch of its own."""
    from veristrata.engine import Engine

    e = Engine(spark, str(tmp_path / "db"))
    kind = "id bigint, session_id string, tool string, path string, content string"

    def drained(name, path, body):
        source = tmp_path / name
        source.mkdir(exist_ok=True)
        write(source, f"{path}.jsonl", [{"id": 1, "session_id": "s", "tool": "Edit", "path": path, "content": body}])
        run = st.post_edits(e, "/p", lambda: 9, lambda root: (True, "", None))
        spark.readStream.schema(kind).json(str(source)).writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start().awaitTermination()

    drained("one", "a.py", "def f(): pass")
    drained("two", "b.py", "def g(): pass")
    assert sorted(e.snapshots.version().epochs.values()) == [0, 0]
    drained("one", "c.py", "def h(): pass")
    named = st.post_edits(e, "/p", lambda: 9, None, "own")
    batch = spark.createDataFrame([(1, "s", "Edit", "d.py", "def k(): pass")], kind)
    named(batch, 0)
    named(batch, 0)
    assert [(r.id, r.file_path, r.verified) for r in e.claims.orderBy("id").collect()] == [(1, "a.py", True), (2, "b.py", True), (3, "c.py", True), (4, "d.py", True)]
    assert sorted(r["name"] for r in e.symbols.collect()) == ["f", "g", "h", "k"] and sorted(e.snapshots.version().epochs.values()) == [0, 0, 1]
    with pytest.raises(ValueError, match="name"):
        st.post_edits(e, "/p", lambda: 9)(batch, 0)


def test_good_truth_files_stay(spark):
    loads, seen = iter([("a",), None, ("b",)]), []

    def load():
        found = next(loads)
        if found is None:
            raise OSError("gone")
        return found

    run = st.post_edit_sink(load, lambda batch, truth: seen.append(truth))
    for epoch in range(3):
        run(None, epoch)
    assert seen == [("a",), ("a",), ("b",)]


def test_supersession_stream_equals_the_batch(spark, tmp_path):
    """Rows in any order within the delay, over several batches: the least pointer of each id is the batch's; settled state goes."""
    import random

    from veristrata.operators import ledger
    from veristrata.streaming import ledger as sl

    rng = random.Random(3)
    rows = []
    for i in range(1, 121):
        verified = rng.random() < 0.25
        rows.append((i, verified, rng.choice([True, False, None]) if not verified else rng.choice([True, None]), rng.choice(["a", "b", "", None, "c"]), 1000 + i + rng.choice([0, 0, 5])))
    kind = "id bigint, verified boolean, vet_ok boolean, file_path string, recorded_at bigint"
    batch = spark.createDataFrame([r if r[3] != "" else (*r[:3], None, r[4]) for r in rows], kind)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(4):
        part = rows[30 * k : 30 * k + 30]
        rng.shuffle(part)
        write(source, f"{k}.jsonl", [dict(zip(("id", "verified", "vet_ok", "file_path", "recorded_at"), r)) for r in part])
    raw = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(source))
    out = st.drain(sl.supersession(raw, "60 seconds", 3), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.id: r.by for r in out.groupBy("id").agg({"superseded_by": "min"}).toDF("id", "by").collect()}
    assert got == {r.id: r.superseded_by for r in ledger.supersede_claims(batch).where("superseded_by IS NOT NULL").collect()} and len(got) > 40


def test_expiry_stream(spark, tmp_path):
    from veristrata.streaming import ledger as sl

    source, touched = tmp_path / "in", tmp_path / "touched"
    source.mkdir()
    touched.mkdir()
    claim = lambda i, at, ttl=10, verified=True: {"id": i, "verified": verified, "recorded_at": at, "last_checked": None, "ttl": ttl}
    write(source, "1.jsonl", [claim(1, 100), claim(2, 100), claim(3, 100, None), claim(4, 100, 10, False), claim(5, 100, 20)])
    write(source, "2.jsonl", [claim(6, 121)])
    write(touched, "1.jsonl", [{"id": 2, "at": 105}])
    kinds = "id bigint, verified boolean, recorded_at bigint, last_checked bigint, ttl bigint", "id bigint, at bigint"
    stream = lambda: sl.expiry(spark.readStream.schema(kinds[0]).option("maxFilesPerTrigger", 1).json(str(source)), spark.readStream.schema(kinds[1]).option("maxFilesPerTrigger", 1).json(str(touched)))
    told = lambda: [tuple(r) for r in st.drain(stream(), str(tmp_path / "out"), str(tmp_path / "c")).orderBy("at", "id").collect()]
    assert told() == [(1, True, 110), (2, True, 115), (5, True, 120)]
    write(touched, "3.jsonl", [{"id": 1, "at": 125}])
    write(source, "3.jsonl", [claim(7, 200)])
    assert told()[3:] == [(1, False, 125), (6, True, 131), (1, True, 135)]


def test_expiry_holds_claims_in_groups(spark, tmp_path):
    """State and timers are a few a group, not a claim's own; rows without a time are left out."""
    from veristrata.streaming import ledger as sl

    rows = [{"id": i, "verified": True, "recorded_at": 1000 + i, "last_checked": None, "ttl": 10 + i % 7} for i in range(300)]
    write(tmp_path, "1.jsonl", [*rows, {"id": 999, "verified": True, "recorded_at": None, "last_checked": None, "ttl": 1}])
    raw = spark.readStream.schema("id bigint, verified boolean, recorded_at bigint, last_checked bigint, ttl bigint").json(str(tmp_path))
    query = sl.expiry(raw, groups=4).writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.id, r.at) for r in spark.table("expired").collect() if r.stale)
    assert got == [(i, 1010 + i + i % 7) for i in range(300) if 1010 + i + i % 7 < 1299]
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 16


@pytest.mark.parametrize("chunk", [9, 1000])
def test_supersession_stream_over_blocks(spark, tmp_path, chunk):
    """Pointers that cross blocks, some without any success; of successes a group beyond the blocks sees no more than a block's first."""
    import random

    import pyarrow as pa

    from veristrata.operators import ledger
    from veristrata.streaming import ledger as sl

    rng = random.Random(chunk)
    rows = []
    for i in range(400):
        verified = rng.random() < (0.05 if i % 100 < 80 else 0.6)
        rows.append({"id": i, "verified": verified, "vet_ok": rng.choice([True, False, None]) if not verified else rng.choice([True, None]), "file_path": rng.choice(["a", "a", "b", "", None, f"f{i % 9}"]), "recorded_at": 1000 + i})
    kind = "id bigint, verified boolean, vet_ok boolean, file_path string, recorded_at bigint"
    source = tmp_path / "in"
    source.mkdir()
    mixed = rng.sample(rows, len(rows))
    for k in range(2):
        write(source, f"{k}.jsonl", mixed[k::2])
    raw = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(source))
    out = st.drain(sl.supersession(raw, "1 hour", 3, 16, chunk), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r.id: r.by for r in out.groupBy("id").agg({"superseded_by": "min"}).toDF("id", "by").collect()}
    batch = spark.createDataFrame([tuple(r.values()) if r["file_path"] != "" else (*list(r.values())[:3], None, r["recorded_at"]) for r in rows], kind)
    assert got == {r.id: r.superseded_by for r in ledger.supersede_claims(batch).where("superseded_by IS NOT NULL").collect()} and len(got) > 100

    all_good = pa.RecordBatch.from_pydict({"id": pa.array(range(4000), pa.int64()), "at": pa.array(range(4000), pa.int64()), "success": [True] * 4000, "failure": [False] * 4000, "file": ["a"] * 4000})
    dealt = pa.Table.from_batches(sl._dealt(16, 1000, 10_000)([all_good])).to_pylist()
    assert len([r for r in dealt if r["file"] == "" and r["part"] < 0]) == 16 * 4 and len([r for r in dealt if r["part"] >= 0 and r["file"] is not None]) == 8000
