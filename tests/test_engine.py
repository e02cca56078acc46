import pytest
from pyspark.sql import functions as F

from veristrata.engine import Engine
from veristrata.operators import audit, detect
from veristrata.sources import trees
from veristrata.store import Change, Version


def test_index_is_incremental(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(x): return x\nclass C:\n    def m(self): pass\n")
    (src / "bad.py").write_text("def (")
    e = Engine(spark, str(tmp_path / "db"))
    assert [r.path for r in e.index(str(src)).collect()] == ["bad.py"]
    assert sorted(r["name"] for r in e.symbols.collect()) == ["C", "f", "m"] and e.files.count() == 2
    (src / "a.py").write_text("def g(): pass\n")
    (src / "bad.py").unlink()
    e.index(str(src)).count()
    assert [r["name"] for r in e.symbols.collect()] == ["g"] and [r.path for r in e.files.collect()] == ["a.py"]
    assert [r.exists for r in e.verify_symbol("g").collect()] == [True]
    assert [(r["name"], r.exists) for r in e.verify_symbol("G").collect()] == [("g", False)]
    assert e.list_files("*.py").count() == 1 and e.find_symbol("g", "function").count() == 1


def test_ledger_round(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    a = e.record_decision("t", "x", "because", 10, related_files=["gone.py"], truth_change=("domain", ["p"], None, None, None, False, None))
    b = e.supersede_decision(a, "y", "better", 20)
    assert [r.id for r in e.get_decisions().collect()] == [b, a]
    assert [r.missing for r in e.get_stale_decisions().collect()] == ["gone.py"]
    assert [r.id for r in e.truth_history("p").collect()] == [a]
    e.record_claim("vet failed", "", False, 30, file_path="f", vet_ok=False, tool="hook")
    c = e.record_claim("open", "", False, 31, file_path="g")
    e.record_claim("fixed", "", True, 40, file_path="h", vet_ok=True)
    assert [r.id for r in e.unverified_claims().collect()] == [c]
    e.resolve_claim(c, "done")
    assert e.unverified_claims().count() == 0


def test_check_and_audit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "line\nI shipped Go. Nothing else here")], "id bigint, text string")
    facts = spark.createDataFrame(trees.flatten({"a": 1}), "path string, vtype string, svalue string, nvalue double")
    found = Engine(spark, str(tmp_path / "db")).check(docs, facts, spark.createDataFrame([(1, "nothing else")], "ord int, text string"))
    assert [(r.verdict, r.line) for r in found.orderBy("start").collect()] == [("unverified", 2), ("forbidden", 2)]
    assert audit.flagged(found).first().forbidden == 1
    h = audit.hybrid(docs, detect.detect(docs, facts), lambda t: "Nothing" in t)
    assert [r.category for r in h.orderBy("start").collect()] == ["tech_in_production", "llm"]


def test_audit_texts(spark):
    item = "claims array<struct<text:string,verdict:string,path:string>>"
    e = spark.createDataFrame([("s", "Edit", "p", "2024-01-02T03:04:05Z", 1, 0, 0, [("a|b", "forbidden", "#1"), (None, "verified", None)]), ("s", "Edit", "q", "?", 0, 0, 5, [])], f"session_id string, tool string, path string, timestamp string, forbidden int, unverified int, recorded_at bigint, {item}")
    assert audit.audit_lines(e).count() == 1
    assert [r.value for r in audit.audit_markdown(e).collect()] == ["## 2024-01-02 — p — FORBIDDEN HIT\n\n**Claims made:**\n- a\\|b — FORBIDDEN (do-not-claim.md##1)\n-  — VERIFIED\n\n**Tool:** Edit  \n**Session:** s  \n**Timestamp:** 2024-01-02T03:04:05Z\n\n"]
    m = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, " ")], "k string, o int, t string")
    assert audit.fold_messages(m, "k", "o", "t").first().message == "one\n\ntwo"
    d = spark.createDataFrame([(1, "t", "c", 5)], "id bigint, topic string, choice string, recorded_at bigint")
    assert audit.session_start(d, "startup").first().line == "- [t] c" and audit.session_start(d, "clear").count() == 0


def test_sync_reports_changes_and_errors(spark):
    leaves = spark.createDataFrame([("pr.a", "string", "open", None), ("pr.b", "string", "open", None), ("x", "string", "y", None)], "path string, vtype string, svalue string, nvalue double")

    def fetch(path, old):
        if path == "pr.b":
            raise RuntimeError("rate limit")
        return "merged"

    new, changes = audit.sync(leaves, fetch, "^pr[.]")
    assert {r.path: r.svalue for r in new.collect()} == {"pr.a": "merged", "pr.b": "open", "x": "y"}
    assert {(r.path, r.reason) for r in changes.collect()} == {("pr.a", "synced"), ("pr.b", "rate limit")}
    assert audit.fact_changes(leaves, new, "r").select(F.max("path")).first()[0] == "pr.a"


def test_check_forgives_a_rules_edits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "We say Terraform iz great"), (2, "terraform is great."), (3, "Terraform is gret"), (4, "Terraform is greatly")], "id bigint, text string")
    facts = spark.createDataFrame([], "path string, vtype string, svalue string, nvalue double")
    e = Engine(spark, str(tmp_path / "db"))
    hits = lambda rules: sorted((r.id, r.start, r.end) for r in e.check(docs, facts, rules).where("verdict = 'forbidden'").collect())
    assert hits(spark.createDataFrame([(1, "Terraform is great", 1)], "ord int, text string, fuzz int")) == [(1, 7, 25), (2, 0, 18), (3, 0, 17)]
    assert hits(spark.createDataFrame([(1, "Terraform is great", 0)], "ord int, text string, fuzz int")) == [(2, 0, 18)]
    assert len(hits(spark.createDataFrame([(1, "Terraform is great")], "ord int, text string"))) == 3
    assert e.check(docs, facts, None, most_bytes=17).count() == 0
    assert e.corpus_summary(docs, facts, spark.createDataFrame([(1, "Terraform is great")], "ord int, text string")).first().message == "4 files: 3 with forbidden claims"


def test_post_edit_flow(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    kind = "id bigint, session_id string, tool string, path string, content string"
    edit = lambda *rows: spark.createDataFrame(list(rows), kind)
    e.post_edit(edit((1, "s", "Edit", "a.py", "def f(): pass"), (2, "s", "Edit", "b.py", "def (")), "/p", 10, lambda root: (False, "# p\nbad line", "exit status 1"), "go vet")
    got = {r.id: r for r in e.claims.collect()}
    assert [got[i].index_ok for i in (1, 2)] == [True, False] and got[1].vet_error_summary == "bad line" and got[1].evidence == "file: a.py\ngo vet: failed\nexit: exit status 1\n# p\nbad line"
    assert [r["name"] for r in e.symbols.collect()] == ["f"] and e.unverified_claims().count() == 2
    e.post_edit(edit((1, "s", "Edit", "c.py", "class C:\n    def m(self): pass")), "/p", 20, lambda root: (True, "", None), "go vet")
    assert e.unverified_claims().count() == 0 and [r.id for r in e.claims.where("verified").collect()] == [3]
    parents = {r["name"]: r.parent_id for r in e.symbols.collect()}
    assert parents["m"] == e.symbols.where("name = 'C'").first().id and parents["C"] is None
    assert e.get_claim(1).first().superseded_by == 3
    for call in (lambda: e.get_claim(99), lambda: e.touch_claims([1, 99], 5)):
        with pytest.raises(KeyError):
            call()
    e.touch_claims([1], 77)
    assert e.claims.where("last_checked = 77").count() == 1
    e.purge_claims(15)
    assert [r.id for r in e.claims.collect()] == [3]


def test_engine_reads(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(x): return x\n")
    e.index(str(src)).count()
    (src / "b.py").write_text("def g(): pass\n")
    e.index_file(str(src), "b.py")
    e.index_file(str(src), "../none.py")
    assert [r.path for r in e.all_files().collect()] == ["a.py", "b.py"] and e.get_file("b.py").count() == 1
    assert e.find_symbol("f", language="python").count() == 1 and e.find_symbol("f", language="go").count() == 0 and e.verify_qualified("a.f").count() == 1
    with pytest.raises(ValueError, match="empty"):
        e.find_symbol("")
    with pytest.raises(ValueError, match="bytes"):
        e.verify_symbol("x" * 5000)
    languages, bad, counts = e.doctor(str(src))
    assert languages.first().n_files == 2 and bad.count() == 0 and tuple(counts.first()) == (0, 0, 0)
    e.record_decision("t", "x", "r", 86400 * 10, truth_change=("domain", ["p"], None, None, None, True, "typo"))
    assert e.truth_story(since="1970-01-05").first().n_trivial == 1 and e.truth_story("toolkit").count() == 0
    for bad_call in (lambda: e.truth_story("x"), lambda: e.truth_story(since="yesterday")):
        with pytest.raises(ValueError, match="x|yesterday"):
            bad_call()
    facts = spark.createDataFrame(trees.flatten({"a": {"b": "Atlas", "last_verified": "2020-01-01"}}), "path string, vtype string, svalue string, nvalue double")
    assert e.list_facts(facts, "a").count() == 2 and e.lint(facts, "2024-01-01").count() == 1 and e.stats(facts, None, {"x": {}}).count() == 2
    docs = spark.createDataFrame([(1, "atlas b")], "id bigint, text string")
    assert e.facts_impact(docs, facts, "a.b").count() == 1
    e.record_claim("c", "", False, 5, file_path="x\\e\u0301.py", session_id="s")
    assert e.claims.first().file_path == "x/\u00e9.py" and e.session_stop("s").first().n_unverified == 1 and e.session_start("startup").count() == 1
    e.migrate()
    assert e.claims.count() == 1


def test_appends_do_not_lose_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(3) as pool:
        ids = list(pool.map(lambda k: Engine(spark, str(tmp_path / "db")).record_claim(f"c{k}", "", False, k), range(6)))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6] and sorted(r.id for r in Engine(spark, str(tmp_path / "db")).claims.collect()) == [1, 2, 3, 4, 5, 6]


def test_pre_edit(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    kind = "id bigint, tool string, path string, text string, command string"
    said = "first line\nñ We use Terraform"
    rows = [(1, "Write", "docs/a.md", said, None), (2, "Write", "/p/docs/a.md", said, None), (3, "Write", "/elsewhere/a.md", said, None), (4, "Write", "truth/a.md", said, None), (5, "Write", "a.txt", said, None), (6, "Bash", None, "", "echo 'We use Terraform' > x"), (7, "Bash", None, "", "grep 'We use Terraform' x"), (8, "Write", "docs/ok.md", said, None), (9, "Write", "notes/a.md", "sponsored", None), (10, "Write", "docs/b.md", None, None), (11, "Write", "docs/free.md", said, None), (12, "Write", "old/acme/x.md", "", None)]
    events = spark.createDataFrame(rows, kind)
    facts = spark.createDataFrame([], "path string, vtype string, svalue string, nvalue double")
    rules = spark.createDataFrame([(4, "We use Terraform", 0, "never did " + "x" * 300)], "ord int, text string, fuzz int, reason string")
    run = lambda **k: {r.id: (r.decision, r.reason) for r in e.pre_edit(events, facts, rules, "/p", [("closed", "old/([a-z]+)/", ["ACME"])], [("Ad:", "sponsored", "Ad:")], targets=["*.md"], exempt_globs=["docs/free.md"], **k).collect()}
    got = run(overrides=["docs/ok.md"])
    assert [k for k in sorted(got) if got[k][0] == "deny"] == [1, 2, 6, 9, 12]
    assert got[1][1].startswith('Forbidden claim "We use Terraform" at line 2 col 4 matches rule #4 in do-not-claim.md — never did xxx') and "…. Rewrite" in got[1][1] and "line 1 col 7" in got[6][1]
    assert "path_filters[0]: closed" in got[12][1] and got[9][1] == "Content matches content_filters[0] without the required text Ad:."
    loose = run(trusted=False)
    assert {d for d, _ in loose.values()} == {"pass"} and loose[1][1] and loose[8][1]
    assert e.pre_edit(events.where("false"), facts, rules, "/p").count() == 0


def test_stale_claims_of_a_tree(spark, tmp_path):
    for name, text in {"a.md": "# x\nI shipped Go.", "b/c.md": "We use Terraform", "ok.md": "nothing", "gen/d.md": "We use Terraform", ".gitignore": "gen/\n"}.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    e = Engine(spark, str(tmp_path / "db"))
    facts = trees.facts_from_yaml(spark, "x: 1\n")
    rules = spark.createDataFrame([(1, "We use Terraform")], "ord int, text string")
    found, code = e.list_stale_claims(str(tmp_path / "t"), facts, rules)
    assert sorted((r.file, r.line, r.verdict) for r in found.collect()) == [("a.md", 2, "unverified"), ("b/c.md", 1, "forbidden")] and code == 2
    assert e.list_stale_claims(str(tmp_path / "t"), facts, rules, scope="ok*")[1] == 0
    claims, counts = e.verify_claim("I think 95 users", facts)
    assert claims.count() == 2 and "contradiction" not in counts.columns and counts.first().total == 2
    with pytest.raises(ValueError, match="bytes"):
        e.verify_claim("x" * (1 << 20), facts)


def test_logs_and_envelopes_are_bounded(spark, tmp_path):
    (tmp_path / "log").write_text('{"session_id": "s", "path": "p", "forbidden": 1, "unverified": 0, "recorded_at": 5}\n{oops\n[1]\n{"session_id": "t"}\n{"session_id": "' + "x" * (1 << 20) + '"}\n')
    assert sorted(r.session_id for r in trees.audit_log(spark, str(tmp_path / "log")).collect()) == ["s", "t"] and trees.audit_log(spark, str(tmp_path / "log"), "s").count() == 1
    lines = spark.createDataFrame([('{"jsonrpc": "2.0", "id": 1}',), ("[]",), ('"jsonrpc"',), ('{"jsonrpc": "1.0"}',), ("",), (None,)], "value string")
    assert trees.rpc_lines(lines).count() == 1
    assert [r.malformed for r in trees.decode_events(spark.createDataFrame([('{"session_id": "s"}',), ('{"session_id": "' + "x" * 50 + '"}',)], "value string"), most_bytes=40).collect()] == [False, True]


def test_tables_of_an_older_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.snapshots.commit(Version(), claims=Change(spark.createDataFrame([(1, "s", "c", "", False, 5)], "id bigint, session_id string, claim string, evidence string, verified boolean, recorded_at bigint")))
    assert e.unverified_claims().count() == 1 and e.record_claim("d", "", False, 6) == 2 and e.claims.count() == 2


def test_broken_files_keep_a_row_and_no_symbols(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text("def f(): pass\n")
    (src / "n.py").write_text("def g(): pass\n")
    e.index(str(src)).count()
    edit = lambda *rows: spark.createDataFrame(list(rows), "id bigint, session_id string, tool string, path string, content string")
    e.post_edit(edit((1, "s", "Edit", "m.py", "def (")), "/p", 9)
    assert {r.path: r.indexed_at for r in e.files.collect()}["m.py"] == 9 and [r["name"] for r in e.symbols.collect()] == ["g"]
    (src / "n.py").write_text("def (")
    assert [r.path for r in e.index(str(src)).collect()] == ["n.py"]
    assert sorted(r.path for r in e.files.collect()) == ["m.py", "n.py"] and [r["name"] for r in e.symbols.collect()] == ["f"]
    assert e.index(str(src)).count() == 0  # a broken file is not parsed again until it changes
    (src / "n.py").write_text("def h(): pass")
    e.index_file(str(src), "n.py")
    assert sorted(r["name"] for r in e.symbols.collect()) == ["f", "h"]


def test_changes_write_what_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    for k in range(3):
        e.record_claim(f"c{k}", "", False, k, tool="hook")
    before = set(e.snapshots.version().tables["claims"])
    e.resolve_claim(2, "seen")
    new = [p for p in e.snapshots.version().tables["claims"] if p not in before]
    assert sorted(p[0] for p in new) == ["+", "-"] and [spark.read.parquet(p[1:]).count() for p in new] == [1, 1]
    e.touch_claims([1, 3], 50)
    assert {r.id: (r.verified, r.last_checked) for r in e.claims.collect()} == {1: (False, 50), 2: (True, None), 3: (False, 50)}
    e.record_claim("fixed", "", True, 40, vet_ok=True)
    e.record_claim("vet", "", False, 4, vet_ok=False, tool="hook", file_path="x")
    e.record_claim("fixed", "", True, 40, vet_ok=True)
    e.purge_claims(15)
    assert sorted(r.id for r in e.claims.collect()) == [1, 2, 3, 4, 6]


def test_writers_do_not_undo_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = str(tmp_path / "db")
    e = Engine(spark, db)
    ids = [e.record_claim(f"c{k}", "", False, k) for k in range(4)]

    def write(k):
        own = Engine(spark, db)
        own.resolve_claim(ids[k])
        own.record_claim(f"new{k}", "", False, 9)
        own.touch_claims([ids[k]], 100 + k)
        d = own.record_decision("t", str(k), "r", k)
        own.supersede_decision(d, "other", "r", 9)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    got = {r.id: r for r in e.claims.collect()}
    assert [(got[i].verified, got[i].last_checked) for i in ids] == [(True, 100 + k) for k in range(4)] and sorted(r.claim for r in got.values() if r.id > 4) == ["new0", "new1", "new2", "new3"]
    assert e.decisions.count() == 8 and e.decisions.where("superseded_by IS NOT NULL").count() == 4


def test_impact_comes_with_strong_hits_first(spark, tmp_path):
    facts = spark.createDataFrame(trees.flatten({"product": {"name": "Atlas", "kind": "map"}}), "path string, vtype string, svalue string, nvalue double")
    docs = spark.createDataFrame([(1, "atlas alone"), (2, "the name Atlas"), (3, "atlas"), (4, "a map"), (5, "product atlas")], "id bigint, text string")
    got = [(r.path, r.id, r.strong_hits) for r in Engine(spark, str(tmp_path / "db")).facts_impact(docs, facts, "product").collect()]
    assert got == [("product.kind", 4, 0), ("product.name", 2, 1), ("product.name", 5, 1), ("product.name", 1, 0), ("product.name", 3, 0)]
