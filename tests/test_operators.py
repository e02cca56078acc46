import random

import pytest
from pyspark.sql import functions as F

from veristrata import schema
from veristrata.functions import extract as ex
from veristrata.functions import text as tx
from veristrata.operators import detect, fuzzy, guard, index, ledger
from veristrata.sources import trees


def claims(spark, rows):
    kind = "id bigint, file_path string, verified boolean, vet_ok boolean"
    return spark.createDataFrame(rows, kind).withColumns({"recorded_at": F.col("id") * 10, "ttl": F.lit(None).cast("bigint"), "last_checked": F.lit(None).cast("bigint"), "tool": F.lit("t"), "session_id": F.lit("s")})


def replay(rows):
    """Sequential updates, as a ledger would make them."""
    out = {}
    for id_, path, verified, vet in sorted(rows):
        if verified and vet is not None:
            for other, p, v, vo in sorted(rows):
                if other < id_ and not v and out.get(other) is None and ((p == path and p is not None) or vo is False):
                    out[other] = id_
    return out


def test_supersession_equals_a_replay_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.random() < 0.4, rng.choice([True, False, None])) for i in range(1, 120)]
    got = {r.id: r.superseded_by for r in ledger.supersede_claims(claims(spark, rows)).collect()}
    want = replay(rows)
    assert got == {r[0]: want.get(r[0]) for r in rows}


def test_stale_boundary_and_disjointness(spark):
    c = claims(spark, [(1, "a", True, True), (2, "a", True, None), (3, "b", False, None)]).withColumn("superseded_by", F.lit(None).cast("bigint")).withColumn("ttl", F.lit(90))
    assert [r.id for r in ledger.stale(c, 100).collect()] == []
    assert [r.id for r in ledger.stale(c, 101).collect()] == [1]
    assert {r.id for r in ledger.unverified(c).collect()} == {3}


def test_purge_spares_rows_without_a_tool(spark):
    c = spark.createDataFrame([(1, None, 5, 1), (2, "x", 5, 1), (3, "x", None, 1), (4, "", 5, 1)], "id bigint, tool string, superseded_by bigint, recorded_at bigint")
    assert [r.id for r in ledger.purge(c, 10).orderBy("id").collect()] == [1, 3, 4]


def test_supersede_decision(spark):
    d = spark.createDataFrame([(1, "t", "c", "r", 5, None), (2, "u", "c", "r", 6, 9)], "id bigint, topic string, choice string, reasoning string, recorded_at bigint, superseded_by bigint")
    got = {r.id: r for r in ledger.supersede(d, 1, 3, "n", "why", 7).collect()}
    assert got[1].superseded_by == 3 and got[3].topic == "t" and got[3].superseded_by is None
    assert ledger.supersede(d, 2, 3, "n", "why", 7).count() == 2


def test_byte_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(i, 100) for i in range(5)], "id bigint, n bigint")
    assert [r.id for r in ledger.within_bytes(rows, F.col("n"), ["id"], 10).collect()] == [0]
    assert ledger.within_bytes(rows, F.col("n"), ["id"], 300).count() == 3


def test_limits():
    assert schema.clamp(0, (50, 500)) == 50 and schema.clamp(900, (50, 500)) == 500 and schema.clamp(-3, (50, 500)) == 50


def test_offsets_are_bytes(spark):
    df = spark.createDataFrame([("é 12 x 345",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.matches("t", "[0-9]+")).collect()]
    assert [(m.start, m.end, m.text) for m in got[0]] == [(3, 5, "12"), (8, 11, "345")]
    assert got[1] == [] and not got[2]


def test_sentences_and_lines(spark):
    df = spark.createDataFrame([("Añb. c!\n\nd",)], "t string")
    s = df.select(tx.sentences("t").alias("s")).first().s
    assert [(x.start, x.end, x.text) for x in s] == [(0, 4, "Añb"), (5, 7, " c"), (10, 11, "d")]
    assert df.select(tx.line_of(F.col("t"), F.lit(10))).first()[0] == 3


def test_globs():
    import re

    m = lambda g, p: bool(re.search(tx.glob_regex(g), p))
    assert m("src/*.go", "src/a/b.go") and m("a?c", "abc") and not m("a?c", "ac") and m("[ab]x", "bx")
    s = lambda g, p: bool(re.search(tx.segment_glob_regex(g), p))
    assert s("**/en/*.md", "a/b/en/x.md") and s("**/en/*.md", "en/x.md") and not s("a/*.md", "a/b/c.md") and s("docs/**", "docs/a/b")


def brute_fuzzy(text, needle, k):
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    hits, low, want, n, out, i = fuzzy.exact(text, needle), text.lower(), needle.lower(), len(needle), [], 0
    runs = fuzzy._RUNS.findall(want)
    least = max(1, n - k)
    while i <= len(text) - least:
        clash = next((e for s, e in hits if i < e and i + least > s), None)
        if clash is not None:
            i = clash
            continue
        took = False
        if not (needle[0] in fuzzy._WORD and i and text[i - 1] in fuzzy._WORD):
            for w in [n] + [x for d in range(1, k + 1) for x in (n + d, n - d)]:
                if w < least or i + w > len(text) or any(i < e and i + w > s for s, e in hits) or not fuzzy._bounded(text, i, i + w, needle):
                    continue
                if w > n and needle[-1] in fuzzy._WORD and i + n < len(text) and text[i + n] in fuzzy._WORD:
                    continue
                if dist(low[i : i + w], want) <= k and (not runs or fuzzy._RUNS.findall(low[i : i + w]) == runs):
                    out.append((i, i + w))
                    i += w
                    took = True
                    break
        i += not took
    return sorted(hits + out)


def test_fuzzy_equals_a_plain_scan():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab 1.é") for _ in range(rng.randint(0, 25))).encode()
        needle = "".join(rng.choice("ab 1") for _ in range(rng.randint(1, 6))).strip().encode() or b"a"
        for k in (0, 1, 2):
            assert fuzzy.fuzzy(text, needle, k) == brute_fuzzy(text, needle, k), (text, needle, k)


def test_detect_priorities(spark):
    docs = spark.createDataFrame([(1, "I shipped Go in 2019. I think 95% users and 9,500 requests on 2024-03-05."), (2, ""), (3, None)], "id bigint, text string")
    facts = spark.createDataFrame(trees.flatten({"tech": {"lang": "Go"}, "rel": [{"shipped": "2024-03-05"}], "limits": {"requests": 9000}}), "path string, vtype string, svalue string, nvalue double")
    found = detect.detect(docs, facts, contradicted=detect.contradictions(docs, facts)).orderBy("start").collect()
    assert [(r.category, r.verdict, r.path) for r in found] == [
        ("tech_in_production", "verified", "tech.lang"),
        ("opinion", "opinion", None),
        ("contradiction", "contradiction", "limits.requests"),
        ("date", "verified", "rel[0].shipped"),
    ]


def test_forbidden_exact_boundaries(spark):
    docs = spark.createDataFrame([(1, "Terraform and Terraforming, terraform"), (2, None)], "id bigint, text string")
    rules = spark.createDataFrame([(1, "Terraform")], "ord int, text string")
    assert [(r.start, r.end) for r in detect.forbidden_exact(docs, rules).orderBy("start").collect()] == [(0, 9), (28, 37)]
    assert detect.forbidden_exact(docs, rules.where("false")).count() == 0


def test_private_facts_go(spark):
    leaves = spark.createDataFrame(trees.flatten({"a": {"sensitivity": "private", "b": {"c": 1}}, "ab": 2}), "path string, vtype string, svalue string, nvalue double")
    assert [r.path for r in detect.visible_facts(leaves).collect()] == ["ab"]


def test_index_maintenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, hash string")
    assert sorted(map(tuple, index.upsert_files(old, new).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert sorted(r.path for r in index.changed(new.unionByName(old.where("path = 'a'")), old).collect()) == ["b", "c"]
    assert [r.path for r in index.prune(old, new).collect()] == ["b"]


def test_guards(spark):
    df = spark.createDataFrame([("docs/en/a.md", "sed -i x"), ("x/.Data/y", "cat a"), ("src/fr/b", "a > b")], "path string, command string")
    row = df.select(guard.in_protected_folder(F.col("path"), ".data").alias("p"), guard.command_mutates(F.col("command")).alias("m"), guard.path_filter(F.col("path"), [("l", "src/([a-z]+)/", ["FR"])]).alias("f")).collect()
    assert [tuple(r) for r in row] == [(False, True, None), (True, False, None), (False, True, "l")]


def test_imports(spark):
    s = spark.createDataFrame([(1, 'import (\n  "a/b/v2"\n  z "c/d"\n)')], "id bigint, text string")
    assert {(r.alias, r.path) for r in guard.imports_of(s).collect()} == {("b", "a/b/v2"), ("z", "c/d")}


def test_events_decode(spark):
    good = '{"session_id":"s","hook_event_name":"PreEdit","tool_input":{"file_path":"a","edits":[{"old_string":"x","new_string":"y"},{"old_string":"p","new_string":"q"}]}}'
    rows = trees.decode_events(spark.createDataFrame([(good,), ("{oops",)], "value string")).collect()
    assert rows[0].text == "y\nq" and not rows[0].malformed and rows[1].malformed


def test_rules_and_stories():
    rules = trees.parse_rules('## Tech\n- ❌ "We use X" — never did {fuzz: exact}\n   more\n- ❌ plain {fuzz: 3}\n')
    assert [(r["category"], r["text"], r["fuzz"]) for r in rules] == [("Tech", "We use X", 0), ("Tech", "plain", 3)]
    assert rules[0]["reason"] == "never did more"
    assert trees.parse_stories("## STORY: A b\n### Short version\ntext\n- x\n")["a b"]["short"] == "text\n- x"


def test_rule_files():
    text = "prose\n  ## Plain\n* X We never lose data — nor - time\n- x \"quoted\" - why {fuzz: 2}\n   goes on\n one space does not\n  ## B\n- 🚫 “Curly” rule {fuzz: -1}\n- ✗ no marker\n- Xylophone is none\n- ❌ a {b} {fuzz : exact}\r\n- [x] done\n"
    got = [(r["ord"], r["category"], r["text"], r["reason"], r["fuzz"], r["line"]) for r in trees.parse_rules(text)]
    assert got == [(1, "Plain", "We never lose data", "nor - time", 1, 3), (2, "Plain", "quoted", "why goes on", 2, 4), (3, "B", "“Curly” rule {fuzz: -1}", "", 1, 8), (4, "B", "a {b}", "", 0, 11)]
    assert trees.parse_rules("") == []
    for bad in ("- ❌", '- ❌ ""'):
        with pytest.raises(ValueError, match="line 1"):
            trees.parse_rules(bad)


def test_story_files():
    text = "# title\n### short version\nbefore any story\n## One\n### Short version (tweet)\n a\n\n b\n### Do not drift\n- x\n-y\nz\n### Sensitivity\n\n low \n high\n### Other\nq\n## STORY: Two\n### LONG VERSION\nl\n ## one\n### do-not-drift\n- w\n"
    got = trees.parse_stories(text)
    assert got == {"one": {"name": "one", "line": 22, "short": "", "long": "", "do_not_drift": ["w"], "sensitivity": ""}, "two": {"name": "Two", "line": 19, "short": "", "long": "l", "do_not_drift": [], "sensitivity": ""}}
    one = trees.parse_stories(text.rsplit(" ## one", 1)[0])["one"]
    assert one == {"name": "One", "line": 4, "short": "a\n\n b", "long": "", "do_not_drift": ["x"], "sensitivity": "low"}
    with pytest.raises(ValueError, match="line 2"):
        trees.parse_stories("\n## STORY:\n")


def test_rules_and_stories_of_many_files(spark):
    docs = spark.createDataFrame([(1, "## A\n- ❌ one\n- X two - why\n## S\n### sensitivity\nlow\n"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, trees.rules_of(docs).collect())) == [(1, 1, "A", "one", "", 1, 2), (1, 2, "A", "two", "why", 1, 3)]
    assert sorted(map(tuple, trees.stories_of(docs).collect())) == [(1, "A", 1, "", "", [], ""), (1, "S", 4, "", "", [], "low")]
    assert trees.rules_of(docs.limit(0)).collect() == trees.stories_of(docs.limit(0)).collect() == []


def test_trees_are_scanned_without_opening_skipped_folders(spark, tmp_path):
    from veristrata.sources import walk

    for k in range(300):
        p = tmp_path / f"node_modules/m{k}/lib/a.py"
        p.parent.mkdir(parents=True)
        p.write_text("x = 1\n")
    names = ("pkg/__init__.py", "pkg/_x.py", "pkg/a.py", "_lib/b.py", ".github/c.py", "gen/d.py", "gen/keep/e.py", "own/f.py", "deep/a/b/c/d/g.py", "docs/_intro.md", "docs/D.MD")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("y = 2\n")
    (tmp_path / ".gitignore").write_text("gen/\n!gen/keep\n*.tmp\r\n")
    (tmp_path / ".veristrataignore").write_text("/own/\n")
    (tmp_path / "pkg/link.py").symlink_to(tmp_path / "gen/d.py")
    (tmp_path / "linked").symlink_to(tmp_path / "gen")
    want = [".github/c.py", "_lib/b.py", "deep/a/b/c/d/g.py", "pkg/__init__.py", "pkg/_x.py", "pkg/a.py"]
    assert sorted(r.path for r in trees.scan_tree(spark, str(tmp_path))[0].collect()) == want
    walker = walk.Walker(str(tmp_path), trees.SKIPPED, ("gen/", "/own/"))
    assert [f[0] for f in walker.files("") if f[0].endswith(".py")] == want or sorted(f[0] for f in walk.Walker(str(tmp_path), trees.SKIPPED, ("gen/", "/own/")).files("") if f[0].endswith(".py")) == want
    assert walker.opened == 10  # the root, pkg, _lib, .github, docs and five of deep: none of 300 modules
    few = walk.plan(walk.Walker(str(tmp_path), trees.SKIPPED), planned=2)
    assert [p.folders for p in few if p.folders] and sorted(f[0] for p in few for f in [*p.found, *(x for d in p.folders for x in walk.Walker(str(tmp_path), trees.SKIPPED).files(d))]) == sorted(f[0] for f in walk.Walker(str(tmp_path), trees.SKIPPED).files(""))
    assert [r.path for r in trees.scan_file(spark, str(tmp_path), "pkg/__init__.py").collect()] == ["pkg/__init__.py"] and trees.scan_file(spark, str(tmp_path), "pkg/link.py").collect() == []
    assert sorted(r.path for r in trees.markdown_files(spark, str(tmp_path)).collect()) == ["docs/D.MD", "docs/_intro.md"]
    assert [r.path for r in trees.markdown_files(spark, str(tmp_path), "gen/*.py").collect()] == ["gen/d.py"] and trees.markdown_files(spark, str(tmp_path), "g*/k**").count() == 1
    assert trees.scan_tree(spark, str(tmp_path / "none"))[0].collect() == []


def test_markdown_is_read_whole_and_without_a_limit(spark, tmp_path):
    for k in range(520):
        (tmp_path / f"f{k}.md").write_text("x")
    (tmp_path / "long.md").write_text("ñ" * 700_000)
    rows = trees.markdown_files(spark, str(tmp_path)).select("path", F.length("text").alias("n")).collect()
    assert len(rows) == 521 and max(r.n for r in rows) == 700_000
    assert trees.scan_markdown(spark, str(tmp_path)).count() == 500


def test_tree_scan(spark, tmp_path):
    for name, text in {"a/m.py": "def f(x): return x\n", "node_modules/b.py": "x=1", "c.go": "package p\nfunc F() {}\n", "d.bin": "z", "skip/e.py": "y=1"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    good, bad = trees.scan_tree(spark, str(tmp_path), ["skip/"])
    assert sorted((r.path, r.language) for r in good.collect()) == [("a/m.py", "python"), ("c.go", "go")] and bad.count() == 0
    files = good.select("path", "language", F.decode("content", "UTF-8").alias("text"))
    assert sorted((r["name"], r.qualified_name) for r in ex.extract(files).collect()) == [("F", "p.F"), ("f", "a.m.f")]


GO = """package p // not here: func X() {}
type (
	T struct{ A int }
	I interface{ M() }
)
type V[K comparable, W any] struct{ m map[K]W }
type A = T
const (
	X = iota
	Y, _ = 1, "func Z() {"
)
var d, e int
func (t *V[K, W]) Run(ctx c.Context,
	n int) (err error) { if x { func() {}() }; return nil }
func F[T any](f func(int) bool, xs ...T) map[string]interface{} { return nil }
func g() (error) { return `}` }
"""

TS = """// function hidden() {}
import { a } from "./x";
export const V = "class No {}", w = { x: 1 };
let n = `t ${"function no(){}" + `${ 1 }`}`;
export const arrow = async <T,>(x: T, { y }: P): Promise<T> => { function inner() {} return x; };
const one = x => x + 1, two = 2
const typed: (x: number) => number = (x) => x
const re = /[}/]\\}function no(){}/g, half = a / b / c;
const { p, q } = o; const [r] = s;
enum E { A }
declare module "m" { export function no(): void }
export default function dflt(this: X, ...rest: string[]): { a: string } | null { return {} }
export interface I<T> extends J { m(): void }
type Alias<T> = T extends string ? { a: 1 } : never
abstract class _C<T extends { a: 1 }> extends Mixin(Base)<T> implements I<T> {
  static n = 0; items: T[] = []; cb = (x) => { no() }
  static { boot({}); }
  constructor(private readonly a: string, public b?: number) { super(); }
  @log({ a: 1 }) @cache static async *gen<T>(x: T): AsyncGenerator<T> { yield x }
  get size(): { a: number } { return { a: 1 } }
  default(): this is string { return /}/.test("}") }
  "quoted"(x) { return 1 }
  [Symbol.iterator]() {}
  #hidden() {}
  abstract later(): (x: number) => string;
  last() {}
}
const broken = "no end
function after() {}
"""

RUST = """//! doc
use std::fmt;
/* outer /* fn no() {} */ */
pub const A: &str = "fn no() { ";
static mut B: [u8; 2] = [1, b'}'];
pub(crate) fn c<'a, F: Fn(u8) -> u8>(x: &'a str, mut y: F, (p, q): (u8, u8)) -> Result<Vec<u8>, Box<dyn E>> where F: Copy { let r = r#"}"#; '}'; }
#[derive(Debug)]
pub struct D<T>(T) where T: Clone;
pub enum E2 { X { a: u8 } }
union U { a: u8 }
pub unsafe trait G { fn no(&self); }
pub type H<T> = Vec<T>;
impl<T: Clone> D<T> {
    const K: u8 = 1;
    pub async unsafe fn new(items: Vec<T>) -> Self { Self(items) }
    fn own(&mut self) {}
}
impl<'a> fmt::Display for &'a D<u8> { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { Ok(()) } }
impl G for (u8, u8) { fn no(&self) {} }
impl G for [u8; 2] { fn no(&self) {} }
impl G for std::collections::Map<String, u8> { fn no(self: Box<Self>) {} }
mod inner { pub fn no() {} }
macro_rules! m { () => { fn no() {} } }
extern "C" { fn no(); }
pub extern "C" fn last() {}
"""


def symbols(text, language, path="a/m.x"):
    return [(r["kind"], r["qualified_name"], r["signature"], r["start_line"], r["end_line"], r["exported"]) for r in ex.symbols_of(path, text, language)]


def test_go():
    assert symbols(GO, "go") == [
        ("type", "p.T", "type T struct{...}", 3, 3, True), ("interface", "p.I", "type I interface{...}", 4, 4, True), ("type", "p.V", "type V[K comparable, W any] struct{...}", 6, 6, True), ("type", "p.A", "type A = T", 7, 7, True),
        ("const", "p.X", "const X", 9, 9, True), ("const", "p.Y", "const Y", 10, 10, True), ("var", "p.d", "var d int", 12, 12, False), ("var", "p.e", "var e int", 12, 12, False),
        ("method", "p.V.Run", "func (*V[K, W]) Run(ctx c.Context, n int) (err error)", 13, 14, True), ("function", "p.F", "func F[T any](f func(int) bool, xs ...T) map[string]interface{}", 15, 15, True), ("function", "p.g", "func g() error", 16, 16, False),
    ]
    for bad in ("x := 1", "package p\nfunc f() {"):
        assert ex.symbols_of("a.go", bad, "go")[0]["error"]


def test_typescript():
    got = symbols(TS, "typescript", "s/m.ts")
    assert [x[:3] for x in got] == [
        ("const", "s.m.V", "const V"), ("const", "s.m.w", "const w"), ("var", "s.m.n", "let n"), ("function", "s.m.arrow", "function arrow(x, {...})"), ("function", "s.m.one", "function one(x)"), ("const", "s.m.two", "const two"), ("function", "s.m.typed", "function typed(x)"),
        ("const", "s.m.re", "const re"), ("const", "s.m.half", "const half"), ("function", "s.m.dflt", "function dflt(this, ...rest)"), ("interface", "s.m.I", "interface I"), ("type", "s.m.Alias", "type Alias"), ("type", "s.m._C", "class _C"),
        ("method", "s.m._C.constructor", "constructor(a, b)"), ("method", "s.m._C.gen", "gen(x)"), ("method", "s.m._C.size", "size()"), ("method", "s.m._C.default", "default()"), ("method", "s.m._C.#hidden", "#hidden()"), ("method", "s.m._C.later", "later()"), ("method", "s.m._C.last", "last()"),
        ("const", "s.m.broken", "const broken"), ("function", "s.m.after", "function after()"),
    ]
    lines = {x[1].split(".")[-1]: x[3:] for x in got}
    assert lines["V"] == (3, 3, True) and lines["arrow"] == (5, 5, True) and lines["dflt"] == (12, 12, True) and lines["_C"] == (15, 27, False) and lines["last"] == (26, 26, False)
    for text in ("", "const ;", "function (", "class { }", "export default () => 1", "((((", "}}}", "`${`", "type", "class A<"):
        assert all(r["error"] is None for r in ex.symbols_of("x.ts", text, "typescript"))


def test_rust():
    got = symbols(RUST, "rust", "s/m.rs")
    assert [(*x[:3], x[5]) for x in got] == [
        ("const", "s.m.A", "const A", True), ("var", "s.m.B", "static B", False), ("function", "s.m.c", "fn c(x, y, _)", False), ("type", "s.m.D", "struct D", True), ("type", "s.m.E2", "enum E2", True), ("interface", "s.m.G", "trait G", True), ("type", "s.m.H", "type H", True),
        ("method", "s.m.D.new", "async fn new(items)", True), ("method", "s.m.D.own", "fn own(self)", False), ("method", "s.m.&D.fmt", "fn fmt(self, f)", False), ("method", "s.m._tuple.no", "fn no(self)", False), ("method", "s.m._array.no", "fn no(self)", False), ("method", "s.m.std::collections::Map.no", "fn no(self)", False),
        ("function", "s.m.last", "fn last()", True),
    ]
    assert got[3][3:5] == (8, 8) and got[7][3:5] == (15, 15)


def test_outlines_survive_any_text():
    rng = random.Random(11)
    parts = ["class A", "{", "}", "(", ")", "<", ">", "=>", "=", ";", "\n", " x", ": T", "function f", "const c", "impl T for U", "fn g", "'a", "'", '"', "`", "${", "/", "/*", "*/", "//", "[", "]", ",", "pub ", "export ", "type X", "@d", "#[", "where ", "for "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        for language in ("typescript", "rust"):
            assert all(r["error"] is None and r["start_line"] <= r["end_line"] for r in ex.symbols_of("m.x", text, language)), (language, text)
        ex.symbols_of("m.go", "package p\n" + text, "go")


SOURCES = {
    "java": ("public class A {\n  private final int x = f(1);\n  A(int x) {\n  }\n  public List<String> run(int x) throws E {\n    if (x) { go(); }\n  }\n}\ninterface B { void m(); }\n@interface C {}\nrecord P(int x) {}\nenum Q { X }\n", {("A", "type"), ("A.A", "method"), ("A.run", "method"), ("B", "interface"), ("C", "interface"), ("P", "type"), ("Q", "type")}),
    "ruby": ("module M\n  class A < B\n    def run\n      if x\n      end\n    end\n    def self.make?(x); end\n  end\nend\ndef free\nend\n", {("M", "type"), ("A", "type"), ("A.run", "method"), ("A.make?", "method"), ("free", "method")}),
    "csharp": ("namespace N;\npublic class A : B {\n  public A(int x) : base(x) { }\n  internal async Task<int> Run(string s) => 1;\n}\ninterface I { void M(); }\nrecord struct R(int X);\nstruct S { }\nenum E { X }\ndelegate int D(int x);\n", {("A", "type"), ("A.A", "method"), ("A.Run", "method"), ("I", "interface"), ("R", "type"), ("S", "type"), ("E", "type"), ("D", "type")}),
    "swift": ("class A {\n  init(x: Int) { }\n  private func run() { }\n}\nprotocol P {\n  func need()\n}\nstruct S { }\nenum E { case x }\nfunc free() { }\n", {("A", "type"), ("A.init", "method"), ("A.run", "function"), ("P", "interface"), ("P.need", "method"), ("S", "type"), ("E", "type"), ("free", "function")}),
    "kotlin": ("data class A(val x: Int) {\n  fun run(): Int = 1\n}\ninterface I\nobject O { fun go() {} }\nenum class E { X }\nfun <T> free(x: T) {}\n", {("A", "type"), ("A.run", "method"), ("I", "type"), ("O", "type"), ("O.go", "method"), ("E", "type"), ("free", "method")}),
    "scala": ("case class A(x: Int) {\n  def run(): Int = 1\n}\ntrait T { def m: Int }\nobject O { }\ndef free = 1\n", {("A", "type"), ("A.run", "method"), ("T", "interface"), ("O", "type"), ("free", "method")}),
    "dart": ("abstract class A {\n  int run(int x) {\n    return f(x);\n  }\n}\nvoid main() async {\n  go();\n}\n", {("A", "type"), ("A.run", "function"), ("main", "function")}),
    "c": ("typedef struct P { int x; } P2;\nenum E { X };\nunion U { int a; };\ntypedef unsigned int u32;\nstatic int *run(int x)\n{\n  return 0;\n}\n/* int no() { */\n", {("P", "type"), ("E", "type"), ("U", "type"), ("u32", "type"), ("run", "function")}),
    "cpp": ("namespace n {\nclass A {\n public:\n  int run(int x) const { return x; }\n  void later(int y);\n};\nenum class E { X };\n}\nint A::other(int x) {\n  return x;\n}\n", {("n", "type"), ("A", "type"), ("A.run", "method"), ("A.later", "method"), ("E", "type"), ("other", "function")}),
    "php": ("<?php\nnamespace A\\B;\nclass C {\n  public function run() { }\n}\ninterface I { }\ntrait T { }\nenum E { }\nfunction free() { }\n", {("A\\B", "type"), ("C", "type"), ("C.run", "method"), ("I", "interface"), ("T", "type"), ("E", "type"), ("free", "function")}),
    "lua": ("-- function no()\nlocal function f(x)\nend\nfunction M.g()\nend\nfunction M:h()\nend\n", {("f", "function"), ("g", "method"), ("h", "method")}),
    "bash": ("run() {\n  :\n}\nfunction go {\n  :\n}\n", {("run", "function"), ("go", "function")}),
    "zig": ("pub fn run(x: u8) u8 { return x; }\nconst P = struct { x: u8 };\npub const E = enum { a };\nconst n = 1;\n", {("run", "function"), ("P", "type"), ("E", "type")}),
    "nix": ("{\n  f = x: x;\n  g = { a, b }: a;\n  d = 1;\n}\n", {("f", "function"), ("g", "function")}),
    "elixir": ("defmodule A.B do\n  def run(x), do: x\n  defp own(x) do\n  end\n  defmacro m(x) do\n  end\nend\ndefprotocol P do\nend\n", {("A.B", "type"), ("run", "method"), ("own", "method"), ("m", "method"), ("P", "interface")}),
    "solidity": ("contract A {\n  constructor(uint x) { }\n  function run(uint x) public view returns (uint) { return x; }\n  modifier only() { _; }\n  event E(uint x);\n}\ninterface I { }\nlibrary L { }\n", {("A", "type"), ("A.init", "method"), ("A.run", "method"), ("A.only", "method"), ("A.E", "method"), ("I", "interface"), ("L", "type")}),
    "make": ("X := 1\nY ?= 2\nall: dep\n\t@x = 1\n", {("X", "const"), ("Y", "const"), ("all", "function")}),
    "cmake": ("function(f a)\nendfunction()\nadd_library(lib STATIC a.c)\nadd_executable(app a.c)\noption(FAST \"x\" ON)\n", {("f", "function"), ("lib", "type"), ("app", "type"), ("FAST", "type")}),
    "hcl": ('resource "aws_x" "web" {\n  name = "y"\n}\nvariable "v" { }\n# resource "no" {}\n', {("aws_x", "type"), ("v", "type")}),
    "graphql": ("type A implements I {\n  x: Int\n  y(a: Int): Int\n}\ninterface I { z: Int }\nenum E { X }\nscalar S\nunion U = A\ninput N { a: Int }\n", {("A", "type"), ("A.x", "method"), ("A.y", "method"), ("I", "interface"), ("E", "type"), ("S", "type"), ("U", "type"), ("N", "type")}),
    "proto": ("message M { string a = 1; }\nenum E { X = 0; }\nservice S {\n  rpc Go (M) returns (M);\n}\n", {("M", "type"), ("E", "type"), ("S", "interface"), ("S.Go", "method")}),
    "sql": ("CREATE TABLE IF NOT EXISTS a.t (\n  id int PRIMARY KEY,\n  price numeric(10, 2),\n  PRIMARY KEY (id)\n);\ncreate or replace view v as select 1;\nCREATE UNIQUE INDEX i ON t (id);\ncreate function f() returns int;\n", {("t", "type"), ("t.id", "const"), ("t.price", "const"), ("v", "type"), ("i", "type"), ("f", "function")}),
    "wit": ("interface i {\n  record r { a: u8 }\n  run: func(x: u8) -> u8;\n}\nworld w {\n  export go: func();\n}\n", {("i", "interface"), ("r", "type"), ("i.run", "method"), ("w", "type"), ("w.go", "method")}),
    "erlang": ("-module(m).\n-record(r, {a}).\nrun(X) when X > 1 -> X;\nrun(X) -> X.\n% no() -> x.\n", {("m", "type"), ("r", "type"), ("run", "function")}),
    "r": ("f <- function(x) x\nn <- 1\n", {("f", "function")}),
    "just": ("x := 'a'\nbuild target: dep\n  echo\n@quiet:\n  echo\n", {("x", "const"), ("build", "function"), ("quiet", "function")}),
    "starlark": ('def rule(x):\n    pass\ngo_library(\n    name = "lib",\n    srcs = ["a.go"],\n)\n', {("rule", "function"), ("lib", "type")}),
    "glsl": ("struct L { vec3 p; };\nuniform mat4 view;\nin vec3 pos;\nfloat f;\nvoid main() {\n  vec3 x = pos;\n}\n", {("L", "type"), ("view", "const"), ("pos", "const"), ("main", "function")}),
    "hlsl": ("Texture2D tex : register(t0);\nfloat4 main(float2 uv : TEXCOORD) : SV_Target {\n  return 0;\n}\n", {("tex", "const"), ("main", "function")}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_patterns(language):
    text, want = SOURCES[language]
    got = {(r["qualified_name"].removeprefix("a.b."), r["kind"]) for r in ex.symbols_of("a/b.x", text, language)}
    assert {x for x in want if x[1] != "interface" or x[0]} <= got, got
    extra = {x for x in got - want if not (language, x[0]) in {("java", "B.m"), ("csharp", "I.M"), ("scala", "T.m"), ("graphql", "I.z"), ("graphql", "N.a"), ("graphql", "a"), ("c", "P2")}}
    assert not extra, extra


def test_every_language_has_a_sample():
    assert set(ex.LANGUAGES) == set(SOURCES) and set(trees.EXTENSIONS.values()) | set(trees.NAMES.values()) <= set(ex.LANGUAGES) | set(ex.EXTRACTORS)


def test_modifiers_and_signatures():
    rows = {r["name"]: r for r in ex.symbols_of("a/b.java", "class A {\n  private int own() {\n  }\n  public int all() {\n  }\n  int some() {\n  }\n}\n", "java")}
    assert [rows[n]["exported"] for n in ("A", "own", "all", "some")] == [True, False, True, False] and rows["all"]["signature"] == "fn all()" and rows["A"]["signature"] == "type A"
    assert (rows["A"]["start_line"], rows["A"]["end_line"], rows["own"]["end_line"]) == (1, 8, 3)


def test_python():
    text = "\ufeffX: int = 1\n_y = z = 2\na.b = 3\nclass C(B, metaclass=M):\n    def __init__(self, a, /, b, *c, d=1, **e): pass\n    async def run(self): pass\n    class D: pass\nasync def f(*, k): pass\n"
    assert symbols(text, "python", "s/m.py") == [
        ("var", "s.m.X", "var X", 1, 1, True), ("var", "s.m._y", "var _y", 2, 2, False), ("var", "s.m.z", "var z", 2, 2, True), ("type", "s.m.C", "class C(B)", 4, 7, True),
        ("method", "s.m.C.__init__", "def __init__(self, a, /, b, *c, d, **e)", 5, 5, False), ("method", "s.m.C.run", "def run(self)", 6, 6, True), ("function", "s.m.f", "def f(*, k)", 8, 8, True),
    ]


def test_manifests_and_markup():
    assert ex.symbols_of("a.py", "def (", "python")[0]["error"]
    row = lambda r: (r["name"], r["qualified_name"], r["signature"])
    go = "module m\nrequire (\n a/b v1\n c/d v2 // indirect\n)\nrequire e/f v3\n"
    assert [row(r) for r in ex.symbols_of("x/go.mod", go, "manifest")] == [("a/b", "x.go.a/b", "dependency a/b@v1"), ("c/d", "x.go.c/d", "dependency c/d@v2 (indirect)"), ("e/f", "x.go.e/f", "dependency e/f@v3")]
    pom = "<project xmlns='u'><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>"
    assert [row(r) for r in ex.symbols_of("pom.xml", pom.replace("'", '"'), "manifest")] == [("a", "pom.a", "dependency g:a@1")]
    npm = '{"dependencies": {"x": "^1"}, "devDependencies": {"y": {"version": "2"}, "z": {}}}'
    assert [row(r)[2] for r in ex.symbols_of("package.json", npm, "manifest")] == ["dependency x@^1", "dependency y@2", "dependency z"]
    cargo = '[dependencies]\na = "1"\nb = {version = "2"}\nc = {path = "../c"}\nd = {git = "u"}\n'
    assert [row(r)[2] for r in ex.symbols_of("Cargo.toml", cargo, "manifest")] == ["dependency a@1", "dependency b@2", "dependency c@path", "dependency d@git"]
    vue = ex.symbols_of("x.vue", "<template/>\n<!-- <script>function no(){}</script> -->\n<script>\nexport function f() {}\n</script>", "vue")
    assert [(r["name"], r["start_line"]) for r in vue] == [("f", 4)]
    astro = ex.symbols_of("x.astro", "---\nconst a = 1;\n---\n<script>function g() {}</script>", "astro")
    assert [r["name"] for r in astro] == ["a", "g"]
    cells = '{"cells": [{"cell_type": "code", "source": ["x = 1\\n", "def f(): pass"]}, {"cell_type": "markdown", "source": "def no(): pass"}]}'
    assert [r["name"] for r in ex.symbols_of("n.ipynb", cells, "jupyter")] == ["x", "f"]
    api = "paths:\n  /a:\n    get: {}\n    x-note: {}\ndefinitions:\n  S: {type: object}\n"
    assert [row(r) for r in ex.symbols_of("v/openapi.yaml", api, "openapi")] == [("GET /a", "v.openapi.GET /a", "endpoint GET /a"), ("S", "v.openapi.S", "schema S")]
    assert ex.symbols_of("openapi.yaml", "a: [", "openapi")[0]["error"] and ex.symbols_of("openapi.json", "[1]", "openapi") == []


def test_blanking_keeps_length():
    from veristrata.functions import lexer

    assert set(lexer.TABLE) == set(ex.LANGUAGES)
    rng = random.Random(1)
    parts = list("\"'`/*\n\\ab{}#-$@%()[]<>?=~RsE ") + ["<<~A\n", "A\n", '"""', "${", "#{", "\\(", "/*", "*/", "?>", "<?php", "=begin\n", "\n=end", "$$", "]]", "--[[", 'R"x(', ')x"']
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(30))
        for language in lexer.TABLE:
            b = lexer.blank(t, language)
            assert len(b) == len(t) and b.count("\n") == t.count("\n"), (language, t)
            found = lexer.spans(t, language)
            assert all(x[0] < x[1] for x in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:])), (language, t)


#: Literals that hold what looks like a declaration, or what a simpler reading would take for an end; `Kept` alone is declared.
LITERALS = {
    "java": 'class Kept {\n  String s = """\n  class No {\n  } " \\""" x\n  """;\n  char q = \'"\';\n}\n',
    "csharp": '#region class No1 {\nclass Kept {\n  string a = @"\nclass No { ""x"" \n";\n  string b = $"{(x ? "class No2 {" : "}")} {{";\n  string c = """\n  class No3 { } "" \n  """;\n}\n',
    "kotlin": '/* a /* nested */ class No {\n*/\nclass Kept {\n  val s = """\nclass No2 { ${ f("}") } \n"""\n  val t = "${ if (x) "class No3 {" else "}" }"\n}\n',
    "swift": '/* /* */ class No {} */\nclass Kept {\n  let a = #"class No2 { "quoted" \\(x)"#\n  let b = """\n  class No3 { \\(f("}")) \n  """\n}\n',
    "scala": '/* /* */ class No */\nclass Kept {\n  val a = """\nclass No2 { " \n"""\n  val b = s"${f("class No3 {")}"\n  val c = \'sym\n}\n',
    "dart": "/* /* */ class No {} */\nclass Kept {\n  var a = '''\nclass No2 { ' \n''';\n  var b = r'\\';\n  var c = '${f('class No3 {')}';\n}\n",
    "c": '#define NO struct No {\n#if 0\nstruct No2 {\n  char *s = "unclosed;\n#endif\nstruct Kept {\n  int x;\n};\n#define LONG a \\\n  struct No3 {\n',
    "cpp": '#define NO class No {\nclass Kept {\n  const char* s = R"d(\nclass No2 { )" \n)d";\n  int n = 1\'000;\n  char c = \'"\';\n};\n',
    "php": "<b>class No {</b>\n<?php\nclass Kept {\n  function run() { return <<<EOT\nclass No2 {\n  EOT;\n  }\n}\n#[Attr]\n?>\nclass No3 {\n<?php // class No4 {\n",
    "graphql": '"""\ntype No { "x" }\n"""\ntype Kept {\n  x: Int\n}\n',
    "hcl": 'variable "Kept" {\n  default = "${f("}")} \\""\n  text = <<-EOT\n  variable "No" {\n  EOT\n}\n/* variable "No2" {} */\n',
    "ruby": "=begin\nclass No\n=end\nclass Kept\n  def run\n    x = <<~EOT\n      class No2\n      end\n    EOT\n    y = \"#{f(\"class No3\")} # \"\n    z = %q(\n class No4\n end)\n    w = a =~ /\"#/\n  end\nend\n__END__\nclass No5\n",
    "elixir": 'defmodule Kept do\n  @moduledoc """\n  defmodule No do\n  """\n  x = ~s(\n  defmodule No2 do)\n  y = ?"\n  z = "#{f("}")} defmodule"\nend\n',
    "lua": "--[==[ ]]\nfunction No()\n]==]\nfunction Kept()\n  local s = [=[\nfunction No2() ]]\n]=]\nend\n",
    "bash": "Kept() {\n  cat <<EOF\nNo() {\nEOF\n  x=\"$(f \"y\")\nNo2() {\n\"\n  echo ${a#b}\n}\n",
    "nix": "{\n  Kept = x: ''\n    no = y: ${f ''}''}\n    ''${z} '''\n  '';\n  /* no2 = x: x; */\n}\n",
    "cmake": "#[[\nfunction(No)\n]]\nfunction(Kept a)\n  set(x [==[\nfunction(No2)\n]]]==])\n  set(y \"\nfunction(No3)\n\")\nendfunction()\n",
    "sql": "/* /* */ create table No (x int); */\ncreate table Kept (\n  x text default 'it''s\ncreate table No2 (y int);'\n);\ncreate function f() returns int as $body$\ncreate table No3 (z int);\n$body$ language sql;\n",
    "erlang": '-module(Kept).\nx() -> "\nno(X) -> ", $".\n% no2(X) -> x.\n',
    "r": 'Kept <- function(x) r"(\nno <- function(y) " ")"\ns <- "\nno2 <- function(y) \\" "\n',
    "starlark": 'def Kept(x):\n    """\n    name = "No"\ndef No2(x):\n    """\n    y = "#"\n',
    "zig": "pub fn Kept() void {\n  const s =\n    \\\\pub fn no() void {\n    \\\\\"\n  ;\n}\n",
}


@pytest.mark.parametrize("language", sorted(LITERALS))
def test_literals_declare_nothing(language):
    got = {r["name"] for r in ex.symbols_of("m.x", LITERALS[language], language)}
    assert "Kept" in got and not any(x.lower().startswith("no") for x in got), got


def test_lexing_is_linear():
    import time

    from veristrata.functions import lexer

    began = time.perf_counter()
    for text in ("/*" * 300_000, '"' * 300_000, "${" * 200_000, '"${' * 150_000, "<<A\n" * 60_000, "'a" * 200_000):
        for language in ("kotlin", "ruby", "csharp", "bash"):
            lexer.blank(text, language)
    assert time.perf_counter() - began < 60


def test_supersession_in_a_hot_file(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 5)
    rows = [(i, "hot", i % 17 == 0, True if i % 17 == 0 else [None, False][i % 2]) for i in range(1, 90)]
    got = {r.id: r.superseded_by for r in ledger.supersede_claims(claims(spark, rows)).collect()}
    want = replay(rows)
    assert got == {r[0]: want.get(r[0]) for r in rows}


def test_chains_of_any_length(spark):
    rows = [(i, i + 1 if i < 500 else None) for i in range(501)] + [(900, 901), (1000, None)]
    got = {r.id: (r.head, r.depth) for r in ledger.chain_heads(spark.createDataFrame(rows, "id bigint, superseded_by bigint")).collect()}
    assert got[0] == (500, 500) and got[499] == (500, 1) and got[500] == (500, 0) and got[900] == (901, 1) and got[1000] == (1000, 0)
    assert ledger.chain_heads(spark.createDataFrame([], "id bigint, superseded_by bigint")).count() == 0
    with pytest.raises(ValueError, match="circle"):
        ledger.chain_heads(spark.createDataFrame([(1, 2), (2, 1)], "id bigint, superseded_by bigint"))


def test_offsets_of_many_matches(spark):
    text = "é 1, " * 1000
    df = spark.createDataFrame([(text,)], "t string")
    raw = text.encode()
    got = df.select(tx.matches("t", "[0-9]").alias("m"), tx.sentences("t").alias("s")).first()
    assert [m.start for m in got.m] == [i for i, c in enumerate(raw) if c == ord("1")] and len(got.s) == 1
    many = spark.createDataFrame([("ab. " * 500,)], "t string").select(tx.sentences("t")).first()[0]
    assert [(s.start, s.end) for s in many[:3]] == [(0, 2), (3, 6), (7, 10)] and len(many) == 500


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Term7 and term2999, term30001")], "id bigint, text string")
    rules = spark.range(3000).selectExpr("cast(id AS int) AS ord", "concat('term', id) AS text")
    for most in (10, 10_000):
        monkeypatch.setattr(detect, "BROADCAST_RULES", most)
        assert [(r.ord, r.start) for r in detect.forbidden_exact(docs, rules).orderBy("start").collect()] == [(7, 0), (2999, 10)]
    assert sorted((r.ord, r.start) for r in fuzzy.forbidden_fuzzy(docs, rules, 0).collect()) == [(7, 0), (2999, 10)]


def test_contradictions_by_context(spark):
    texts = ["we serve (9,500) api requests daily", "9500 requests", "api requests reach 7000, maybe 2015 or 0", "requests " + "x " * 5000 + "9500", "the limit of requests is 9000 api"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    leaves = trees.flatten({"limits": {"api": {"requests": 9000}, "requests": 8000}, "zero": 0, "big": {"requests": 10**9}, "years": 2015})
    leaves += [(f"other.k{i}", "number", str(i), float(10 * i)) for i in range(1, 3001)]
    facts = spark.createDataFrame([x for x in leaves if x[3] != 9500.0 and x[3] != 7000.0], "path string, vtype string, svalue string, nvalue double")
    got = sorted((r.id, texts[r.id].encode()[r.start : r.end].decode(), r.path) for r in detect.contradictions(docs, facts).collect())
    assert got == [(0, "9,500", "limits.api.requests"), (1, "9500", "limits.api.requests"), (2, "7000", "limits.api.requests")]
    assert detect.contradictions(docs, facts.where("false")).count() == 0


def test_fuzzy_pieces_lose_no_rule():
    rng = random.Random(8)
    needles = [("".join(rng.choice("ab c") for _ in range(rng.randint(1, 7))).encode(), rng.randint(0, 2)) for _ in range(60)]
    pieces = fuzzy.Pieces(needles)
    for _ in range(400):
        text = "".join(rng.choice("ab cé") for _ in range(rng.randint(0, 20))).encode()
        near = set(pieces.near(text))
        assert all(i in near for i, (n, k) in enumerate(needles) if fuzzy.fuzzy(text, n, k))


def test_edit_distance_is_bounded():
    assert fuzzy.edit_distance(b"kitten", b"sitting", 5) == 3 and fuzzy.edit_distance(b"kitten", b"sitting", 2) == 3 and fuzzy.edit_distance(b"", b"ab", 2) == 2


def test_impact_is_at_word_boundaries_and_in_context(spark):
    docs = spark.createDataFrame([(1, "xatlasx\nfoo atlas"), (2, "atlas\n\nand now we say the product is called Atlas")], "doc_id bigint, text string")
    leaves = spark.createDataFrame([("product.name", "atlas")], "path string, svalue string")
    got = sorted(map(tuple, detect.facts_impact(docs, leaves).collect()))
    assert got == [("product.name", 1, 1, 0, 2), ("product.name", 2, 2, 1, 3)]


def test_key_paths(spark):
    leaves = spark.createDataFrame(trees.flatten({"a": {"b": [1, {"c": 2}]}, "ab": 3}), "path string, vtype string, svalue string, nvalue double")
    assert sorted(r.path for r in detect.at_path(leaves, "a").collect()) == ["a.b[0]", "a.b[1].c"] and detect.at_path(leaves, "a.b[1]").count() == 1
    for bad in ("a.x", "a.b[7]", "a..b", "[0"):
        with pytest.raises(ValueError, match="a|0"):
            detect.at_path(leaves, bad)


def test_shaping(spark):
    df = spark.createDataFrame([("é" * 10, 1, "a\nb"), (None, 2, "")], "t string, n int, x string")
    got = df.select(tx.cut_bytes(F.col("t"), 8, "…").alias("c"), tx.plural(F.col("n"), "file").alias("p"), tx.one_line(F.col("x"), 5).alias("o"), tx.human_duration(F.col("n") * 4000).alias("h")).collect()
    assert tuple(got[0]) == ("éé…", "1 file", "a", "1h") and tuple(got[1]) == (None, "2 files", "", "2h")
    paths = [("a/../b", "/r/b"), ("/r/c/./d", "/r/c/d"), ("../x", None), ("/r/../y", None), ("", None), ("a\nb", None), ("/rx/a", None), (".", "/r")]
    df = spark.createDataFrame(paths, "p string, want string")
    assert df.where(~tx.contained(F.col("p"), "/r/").eqNullSafe(F.col("want"))).count() == 0


def test_source_sets(spark):
    df = spark.createDataFrame([("x/BUILD", "starlark", "starlark"), ("a.TF", "hcl", "hcl"), ("a.js", None, "javascript"), ("b.jsx", "typescript", "javascript"), ("x/OpenAPI.yaml", "openapi", None), ("pom.xml", "manifest", "manifest"), ("README", None, None)], "p string, a string, b string")
    assert df.where(~(trees.language_of(F.col("p")).eqNullSafe(F.col("a")) & trees.query_language_of(F.col("p")).eqNullSafe(F.col("b")))).count() == 0


def test_scans(spark, tmp_path):
    for name, text in {"a.md": "1", "out/b.md": "2", ".x/c.md": "3", "docs/d.md": "4", "docs/e/f.md": "5", "truth/g.md": "6", "m.py": "x = 1\n", "gen/n.py": "y = 1\n", ".gitignore": "gen/\n", ".mypy_cache/o.py": "z = 1\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    md = lambda **k: [r.path for r in trees.scan_markdown(spark, str(tmp_path), **k).collect()]
    assert md(exclude=("truth",)) == ["a.md", "docs/d.md", "docs/e/f.md"] and md(scope="docs/*.md") == ["docs/d.md"] and md(limit=1) == ["a.md"]
    assert [r.path for r in trees.scan_tree(spark, str(tmp_path))[0].collect()] == ["m.py"]
    one = lambda p: [r.path for r in trees.scan_file(spark, str(tmp_path), p).collect()]
    assert one("m.py") == ["m.py"] and one("./docs/../m.py") == ["m.py"] and one("../m.py") == [] and one("none.py") == [] and one("docs") == [] and one("a.md") == []


def test_adapters(spark):
    from veristrata.operators import adapters

    config = adapters.read_config('[[adapters]]\ntype = "x"\n[[adapters]]\ntype = "x"\n[[adapters]]\ntype = "y"\n')
    assert adapters.enabled(config, True) == ["x", "y"] and adapters.enabled({}, True) == ["code", "ground-truth"] and adapters.enabled(adapters.read_config(None), False) == ["code"]

    class Says(adapters.Adapter):
        def post_edit(self, events):
            return F.concat(F.lit(self.options["word"] + " "), F.col("path"))

    r = adapters.Registry()
    r.register("x", Says)
    r.register("y", Says)
    with pytest.raises(ValueError, match="taken"):
        r.register("x", Says)
    with pytest.raises(KeyError):
        r.create(["z"])
    e = spark.createDataFrame([(1, "p"), (2, None)], "id bigint, path string")
    got = {x.id: x.message for x in adapters.messages(e, r.create(["x", "y"], {"x": {"word": "a"}, "y": {"word": "b"}}), "post_edit").collect()}
    assert got == {1: "a p\n\nb p"}


def test_post_edit_of_one_path_twice(spark):
    from veristrata.operators import postedit

    files, symbols = spark.createDataFrame([("a.py", "h", "python", 1, 1)], schema.FILES), spark.createDataFrame([(5, "a.py", "old", "a.old", "function", "", 1, 1, True, None)], schema.SYMBOLS)
    edits = spark.createDataFrame([(1, "s", "Edit", "a.py", "def f(): pass"), (2, "s", None, "/p/a.py", "def g(): pass"), (3, "s", "Edit", "notes.txt", "x"), (4, "s", "Edit", "/etc/passwd", "x"), (5, "s", "Edit", "gone.py", None)], "id bigint, session_id string, tool string, path string, content string")
    f, s, e = postedit.apply_edits(edits, files, symbols, "/p", 9)
    assert [r["name"] for r in s.collect()] == ["g"] and [(r.path, r.indexed_at) for r in f.collect()] == [("a.py", 9)]
    claims_ = {r.id: r for r in postedit.claims_of(e, "verify", False, None, "", None, 9).collect()}
    assert sorted(claims_) == [1, 2, 3] and claims_[2].claim == "tool=edit file=a.py; index=ok; verify=skipped (no module)" and claims_[1].verified and claims_[1].vet_ok is None


def test_plugins_are_bounded():
    import sys

    from veristrata.operators import audit

    run = lambda code, **k: audit.run_plugin([sys.executable, "-c", code], {"a": 1}, **k)
    assert run("import json,sys; x=json.load(sys.stdin); print(json.dumps({'b': x['a'] + 1}))") == {"b": 2}
    for code in ("print('[]')", "import sys; sys.exit('no')", "print('{}' + ' ' * 5000)"):
        with pytest.raises((RuntimeError, ValueError)):
            run(code, most=1000)


def test_truth_files(spark, tmp_path):
    from veristrata.operators import audit

    facts = trees.facts_from_yaml(spark, "product:\n  name: Atlas\n  tags: [a, 2]\n  since: 2024-03-05\n")
    assert sorted((r.path, r.vtype, r.svalue) for r in facts.collect()) == [("product.name", "string", "Atlas"), ("product.since", "date", "2024-03-05"), ("product.tags[0]", "string", "a"), ("product.tags[1]", "number", "2")]
    assert trees.facts_from_yaml(spark, None).count() == 0
    with pytest.raises(ValueError, match="map"):
        trees.facts_from_yaml(spark, "- a")
    paths, contents = trees.filters_from_yaml('path_filters:\n  - path_pattern: "applications/([^/]+)/"\n    forbidden_values: [acme]\n    reason: over\ncontent_filters:\n  - content_pattern: sponsored\n    required: "Ad:"\n')
    assert paths == [("over", "applications/([^/]+)/", ["acme"])] and contents == [("Ad:", "sponsored", "Ad:")] and trees.filters_from_yaml("") == ([], [])
    for bad in ("path_filters: x", "path_filters: [1]", "path_filters: [{reason: x}]", "path_filters: [{path_pattern: '('}]", "content_filters: [{content_pattern: 3}]", "path_filters: [{path_pattern: a, forbidden_values: [1]}]"):
        with pytest.raises(ValueError, match="filters"):
            trees.filters_from_yaml(bad)
    for text in ("a: 1\n", "a: 2\n"):
        audit.write_facts(spark, str(tmp_path / "facts.yaml"), text)
        assert (tmp_path / "facts.yaml").read_text() == text
    stories = trees.parse_stories("## STORY: A b\n### Short version\ntext\n")
    assert trees.get_story(stories, " a B")["name"] == "A b"
    with pytest.raises(KeyError):
        trees.get_story(stories, "c")
    with pytest.raises(ValueError, match="line 2"):
        trees.parse_rules('## X\n- ❌ ""\n')


YAML = """
a: {b: [1, 'x, y', {c: ~}], "d": true}   # note
list:
- one
- two: 2
  three: "3\\n"
- - x
text: |
  first
    second

fold: >-
  some
  words
'q k': 0x10
plain: goes
  on
"""


def test_yaml():
    from veristrata.sources import yaml

    assert yaml.load(YAML) == {"a": {"b": [1, "x, y", {"c": None}], "d": True}, "list": ["one", {"two": 2, "three": "3\n"}, ["x"]], "text": "first\n  second\n", "fold": "some words", "q k": 16, "plain": "goes on"}
    assert yaml.load("") is None and yaml.load("- a: 1\n  b: 2\n-\n  - c") == [{"a": 1, "b": 2}, ["c"]] and yaml.load("x: 1.5e3") == {"x": 1500.0}
    for bad in ("a: 1\na: 2", "a: [1, 2", "a: !!int x", "a:\n   b: 1\n  c: 2", "a: *x", "\ta: 1", "a: {b: *y}", "<<: 1"):
        with pytest.raises(ValueError, match="line"):
            yaml.load(bad)


def test_overlaps_equal_a_plain_greedy(spark):
    from veristrata.operators import spans

    rng = random.Random(4)
    rows = []
    for k in range(300):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 40)
            found.append((rng.choice([0, 0, 1, 2, 3, 4, 5, 6]), a, a + rng.randint(1, 9), str(len(found))))
        rows.append((k, found))

    def greedy(found):
        out = []
        for s in sorted(found, key=lambda s: (s[0], s[1])):
            if s[0] == 0 or not any(s[1] < t[2] and s[2] > t[1] for t in out):
                out.append(s)
        return sorted(out, key=str)

    of = lambda s: spans.Span(s[1], s[0], s[2], "c", "v", path=s[3])
    plain = {k: greedy(found) for k, found in rows}
    for k, found in rows:
        got = [x[:3] for x in sorted((x.stage, x.start, x.end) for x in spans.resolve(sorted(map(of, found), key=lambda x: (x.start, x.stage))))]
        assert got == sorted(x[:3] for x in plain[k])
    kind = "k int, stage int, category string, verdict string, start int, end int, text string, subject string, path string"
    df = spark.createDataFrame([(k, s[0], "c", "v", s[1], s[2], None, None, s[3]) for k, found in rows for s in found], kind)
    got = {}
    for r in detect.resolve_overlaps(df).collect():
        got.setdefault(r.k, []).append((r.stage, r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x[:3] for x in v) for k, v in plain.items() if v}


def test_one_pass_equals_the_patterns(spark):
    """Offsets in bytes, years after a preposition, words before and after numbers; texts of any kind."""
    from veristrata.operators import spans

    text = "ñ In 2020 we; since 2021 I Believe 1,200 users of 2022-01-02 ¶ shipped C++ and C#, I built a/b-c.d. 50% live  Go 99.5 GB within 1999"
    got = [(x.category, x.text, x.subject, x.start) for x in sorted(spans.candidates(text.encode()))]
    assert [g[:3] for g in got] == [("opinion", "I Believe", "I Believe"), ("quantitative", "1,200 users", "1,200"), ("date", "2022-01-02", "2022-01-02"), ("personal_action", "I built a/b-c.d.", "a/b-c.d."), ("tech_in_production", "live  Go", "Go"), ("quantitative", "99.5 GB", "99.5")]
    for category, found, _, start in got:
        assert text.encode()[start:].startswith(found.encode())
    assert not any(x.category == "date" and x.text in ("2020", "2021", "1999") for x in spans.candidates(text.encode()))
    ctx = {v: c for _, _, v, c in spans.numbers("é one two THREE (12x) 7,000b four five six seven 2001 8".encode())}
    assert ctx[8.0] == "six seven 2001" and 2001.0 not in ctx and spans.grams("ab") == [] and spans.grams("éa") == ["Ã©a"]
    assert list(spans.candidates(b"")) == list(spans.numbers(b"no digits")) == []


def test_contradictions_meet_an_index_not_lists(spark):
    """100,000 leaves of a few names: the index has a row for each name and magnitude, and no row of the plan holds leaves."""
    leaves = spark.range(100_000).selectExpr("concat('a', id, '.users[', id % 7, '].count') AS path", "'number' AS vtype", "cast(id * 10 + 5 AS string) AS svalue", "cast(id * 10 + 5 AS double) AS nvalue")
    docs = spark.createDataFrame([(1, "we have 12,000 users now"), (2, "we have 12,005 users"), (3, "12,000 things of no name"), (4, None), (5, "ñ Counts: 77")], "id bigint, text string")
    found = detect.contradictions(docs, leaves)
    assert sorted((r.id, r.value, r.path, r.text) for r in found.collect()) == [(1, 12000.0, "a100.users[2].count", "12,000"), (5, 77.0, "a0.users[0].count", "77")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


#: (text, claims as (category, verdict, quoted text, path)), held by byte offsets: multi-byte text, overlaps across stages, years, edges of words.
GOLDEN = [
    ("", []),
    ("Nothing is claimed here, not even 12 things.", []),
    ("Zoë: I believe the production Go service has 1,200 users.", [("opinion", "opinion", "I believe", None), ("tech_in_production", "verified", "production Go", "stack.language"), ("quantitative", "verified", "1,200 users", "limits.users")]),
    ("I shipped Atlas on 2024-03-05, in 2019.", [("personal_action", "verified", "I shipped Atlas", "product.name"), ("date", "verified", "2024-03-05", "releases[0].shipped")]),
    ("2019 was fine; since 2020 too.", [("date", "unverified", "2019", None)]),
    ("Our users number 1,300 by now", [("contradiction", "contradiction", "1,300", "limits.users")]),
    ("We use Terraform, we uze terraform; we use Terraforming.", [("forbidden", "forbidden", "We use Terraform", "#1"), ("forbidden", "forbidden", "we uze terraform", "#1")]),
    ("52 releases and 53 releases", [("forbidden", "forbidden", "52 releases", "#2")]),
    ("I think we use Terraform", [("opinion", "opinion", "I think", None), ("forbidden", "forbidden", "we use Terraform", "#1")]),
    ("I built we use terraform", [("forbidden", "forbidden", "we use terraform", "#1")]),
    ("95 MB, 95% users, 1,200 users.", [("quantitative", "unverified", "95 MB", None), ("quantitative", "verified", "1,200 users", "limits.users")]),
    ("ééé I wrote foo/bar-1.2, yes", [("personal_action", "unverified", "I wrote foo/bar-1.2", None)]),
    ("the limits allow 1200 of them", []),
]
GOLDEN_FACTS = "product: {name: Atlas}\nstack: {language: Go}\nlimits:\n  users: 1200\n  years: 2019\nreleases:\n- shipped: 2024-03-05\n"


def test_golden_claims(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(99, None)], "id bigint, text string")
    facts = trees.facts_from_yaml(spark, GOLDEN_FACTS).where("path <> 'limits.years'")
    rules = spark.createDataFrame([(1, "We use Terraform", 1), (2, "52 releases", 1)], "ord int, text string, fuzz int")
    found = detect.detect(docs, facts, fuzzy.forbidden(docs, rules), detect.contradictions(docs, facts))
    got = {i: [] for i in range(len(GOLDEN))}
    for r in found.orderBy("id", "start").collect():
        raw = GOLDEN[r.id][0].encode()
        assert raw[r.start : r.end].decode() == r.text
        got[r.id].append((r.category, r.verdict, r.text, r.path))
    assert got == {i: want for i, (_, want) in enumerate(GOLDEN)}


def test_joined_rules_equal_a_scan_of_each(spark, monkeypatch):
    """Rules of any number of edits, short ones, ones of few bytes a piece, in any case, beside texts of any bytes: as fuzzy() finds them one by one."""
    rng = random.Random(8)
    words = ["alpha", "beta", "Gamma", "12", "ñu", "x", "delta-9", "of", "Ünder", "the"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rules = [(k, said(rng.randint(1, 5)), rng.choice([0, 0, 1, 1, 2, 3])) for k in range(80)] + [(90, "a", 3), (91, "", 1), (92, None, 1), (93, "beta of", None)]

    def bent(text):
        out = list(text)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(out))
            out[at] = rng.choice(["", out[at] * 2, "q", out[at].upper()])
        return "".join(out)

    texts = [bent(said(rng.randint(1, 30))) for _ in range(60)] + ["", None, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(rules, "ord int, text string, fuzz int")
    want = sorted((i, o, s, e, t.encode()[s:e].decode("utf-8", "replace")) for i, t in enumerate(texts) if t for o, needle, f in rules if needle for s, e in fuzzy.fuzzy(t.encode(), needle.encode(), f or 0))
    got = sorted(map(tuple, fuzzy.joined(docs, table).collect()))
    assert got == want and len(got) > 100
    monkeypatch.setattr(fuzzy, "BROADCAST_RULES", 3)
    assert sorted(map(tuple, fuzzy.forbidden(docs, table, default_fuzz=0).collect())) == want
    assert fuzzy.joined(docs, table.limit(0)).collect() == fuzzy.joined(docs.limit(0), table).collect() == []


def test_equal_texts_and_rules_are_compared_once(spark, tmp_path, monkeypatch):
    """Copies of texts and of rules cost no comparisons; every key and rule has its hits, a key that two texts share too."""
    log = tmp_path / "compared"
    scan = fuzzy.fuzzy

    def counted(raw, needle, threshold):
        with open(log, "a") as f:
            f.write(".")
        return scan(raw, needle, threshold)

    monkeypatch.setattr(fuzzy, "RULE_GROUP", 16)
    docs = spark.createDataFrame([(0, "It is RED BOLT.")] + [(i, f"It is {'red bolt' if i % 2 else 'blue ring'}.") for i in range(200)] + [(900, "red bolts")], "id bigint, text string")
    rules = spark.createDataFrame([(o, "red bolt" if o % 2 else "blue ring", 0) for o in range(100)], "ord int, text string, fuzz int")
    monkeypatch.setattr(fuzzy, "fuzzy", counted)
    got = sorted(map(tuple, fuzzy.matched(docs, rules).collect()))
    assert got == sorted([(i, o) for i in range(200) for o in range(100) if i % 2 == o % 2] + [(0, o) for o in range(1, 100, 2)])
    assert 0 < len(log.read_text()) < 20


def test_files_of_one_part_are_read_by_many_tasks(spark):
    """A small table is one task's to read; extraction deals its files to all cores."""
    files = spark.range(0, 200, 1, 1).selectExpr("concat('a', id, '/openapi.yaml') AS path", "'openapi' AS language", "concat('paths: {/i', id, ': {get: {}}}') AS text")
    got = ex.extract(files).select("name", F.spark_partition_id().alias("p")).collect()
    assert sorted(r[0] for r in got) == sorted(f"GET /i{i}" for i in range(200)) and len({r.p for r in got}) > 4


def test_rows_of_many_copies_are_small_on_disk(spark, tmp_path):
    """Rows that grow with the square of the copies are written as runs; null keys and keys that come twice have theirs too."""
    docs = spark.range(3200).selectExpr("IF(id < 64, NULL, id % 1600) AS id", "concat('It is HUE', id % 64, ' BOLT.') AS text")
    rules = spark.range(19200).selectExpr("cast(id * 7919 AS int) AS ord", "concat('hue', id % 64, ' bolt') AS text", "0 AS fuzz")
    fuzzy.matched(docs, rules).write.parquet(str(tmp_path / "rows"))
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert got.count() == 50 * 300 * 64 and got.where("id IS NULL").count() == 300 * 64
    assert got.where("id % 64 <> ord / 7919 % 64").count() == 0
    assert sorted(map(tuple, got.where("id IS NOT NULL").groupBy("id", "ord").count().groupBy("count").count().collect())) == [(1, 300 * 64), (2, 24 * 300 * 64)]
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < got.count()


def test_yaml_anchors_aliases_merges_and_tags():
    from veristrata.sources import yaml

    text = """
base: &base
  name: atlas
  n: &n 5
list: &l
  - &first one
  - *first
  - &m
    k: v
  - !!str 12
other:
  <<: *base
  n: 6
flow: {<<: [*m, {k: w, z: 1}], a: *n, b: &f [1, 2], c: *f}
tags: [!!str 1, !!float 2, !own x, !!int "3"]
text: !!str |
  1
block: &b |
  two
again: *b
seq: *l
none: !!null
own: !thing {a: 1}
empty: &e
after: *e
--- 
second: document
"""
    got = yaml.load(text)
    assert got == {
        "base": {"name": "atlas", "n": 5}, "list": ["one", "one", {"k": "v"}, "12"], "other": {"name": "atlas", "n": 6}, "flow": {"a": 5, "b": [1, 2], "c": [1, 2], "k": "v", "z": 1}, "tags": ["1", 2.0, "x", 3],
        "text": "1\n", "block": "two\n", "again": "two\n", "seq": ["one", "one", {"k": "v"}, "12"], "none": None, "own": {"a": 1}, "empty": None, "after": None,
    }
    assert yaml.load("&top\na: 1\n") == {"a": 1} and yaml.load("- &x !!int 7\n- *x") == [7, 7] and yaml.load("a: 1\n---\nb: 2") == {"a": 1} and yaml.load("--- !!map\na: 1") == {"a": 1}
