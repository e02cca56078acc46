"""Sources: source trees, event and audit logs, and the small truth files that people keep."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import scope_regex, segment_glob_regex
from ..tables import filesystem
from . import walk, yaml

# Folders that a scan of sources skips, and one of markdown; what files are by extension and by name, both in lower case.
SKIPPED = (".git", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "vendor", "venv")
MARKDOWN_SKIPPED = ("node_modules", "vendor", "dist", "build", "target", ".next", "out")
EXTENSIONS = {
    "go": "go", "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "java": "java", "rb": "ruby", "cs": "csharp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "dart": "dart",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "php": "php", "lua": "lua", "sh": "bash", "bash": "bash", "zig": "zig", "nix": "nix", "ex": "elixir", "exs": "elixir", "sol": "solidity",
    "mk": "make", "cmake": "cmake", "vue": "vue", "svelte": "svelte", "tf": "hcl", "tfvars": "hcl", "hcl": "hcl", "graphql": "graphql", "gql": "graphql", "proto": "proto", "sql": "sql", "ipynb": "jupyter", "wit": "wit", "astro": "astro",
    "jsx": "typescript", "erl": "erlang", "hrl": "erlang", "r": "r", "bzl": "starlark", "bazel": "starlark", "star": "starlark", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "geom": "glsl", "comp": "glsl", "tesc": "glsl", "tese": "glsl",
    "hlsl": "hlsl", "fx": "hlsl", "fxh": "hlsl",
}
NAMES = {
    "makefile": "make", "gnumakefile": "make", "cmakelists.txt": "cmake", "openapi.yaml": "openapi", "openapi.yml": "openapi", "openapi.json": "openapi", "swagger.yaml": "openapi", "swagger.yml": "openapi", "swagger.json": "openapi",
    "justfile": "just", "build": "starlark", "build.bazel": "starlark", "workspace": "starlark", "workspace.bazel": "starlark", "package.json": "manifest", "cargo.toml": "manifest", "go.mod": "manifest", "pom.xml": "manifest",
}
# Where the language that a query filters by differs from the indexed one: names come first, other script extensions count, and API files have none.
QUERY_EXTENSIONS = {"js": "javascript", "jsx": "javascript"}
QUERY_NO_NAMES = ("openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json")


#: Ignore files at the top of a tree; the second is this engine's own.
IGNORE_FILES = (".gitignore", ".veristrataignore")


def _named(path: Column) -> tuple[Column, Column]:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name, F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language_of(path: Column) -> Column:
    """What the index calls a file: by extension, then by name, whatever the case; null for others. Two literal maps."""
    name, ext = _named(path)
    return F.coalesce(_lookup(EXTENSIONS, ext), _lookup(NAMES, name))


def query_language_of(path: Column) -> Column:
    """What a symbol query's language filter calls a file: by name, then by extension; null for others."""
    name, ext = _named(path)
    return F.coalesce(_lookup({k: v for k, v in NAMES.items() if k not in QUERY_NO_NAMES}, name), _lookup(EXTENSIONS | QUERY_EXTENSIONS, ext))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore-file rules in order: the last that matches decides, and a leading ! takes a path back in."""
    out = F.lit(False)
    for rule, back in walk.ignore_rules(patterns):
        out = F.when(path.rlike(rule), F.lit(not back)).otherwise(out)
    return out


def ignore_patterns(*files: str) -> list[str]:
    """The lines of several ignore files, one after the other, so that a later file can take a path back in."""
    return [line for text in files for line in text.splitlines()]


def read_ignore_files(spark: SparkSession, root: str, names: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """The patterns of the ignore files at the top of a tree, as far as there are any, one file after the other."""
    out = []
    for name in names:
        p, fs = filesystem(spark, f"{root.rstrip('/')}/{name}")
        if fs.exists(p):  # Spark's readers leave hidden files out
            stream = fs.open(p)
            out.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    return ignore_patterns(*out)


_FILE = "path string, hash string, language string, size_bytes bigint, indexed_at bigint, content binary"


def _source_files(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.sha2("content", 256).alias("hash"), "language", F.col("length").alias("size_bytes"), F.col("modified").alias("indexed_at"), "content")


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files with content, failures) of a source tree: skipped folders, ignored paths and unknown kinds left out; files over the
    size limit are failures. Skipped and ignored folders are never opened, and larger files never read; names that begin with a dot or an
    underscore are files like others. Paths are relative to root. ignore: patterns, by default those of the tree's own ignore files."""
    patterns = read_ignore_files(spark, root) if ignore is None else ignore
    rows = walk.read_tree(spark, root, SKIPPED, patterns, most=schema.INDEXED_BYTES).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    small = F.col("length") <= schema.INDEXED_BYTES
    return _source_files(rows.where(small)), rows.where(~small).select("path", F.lit("over the size limit").alias("error"))


def scan_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """One file as scan_tree() gives it; no row if it is missing, a folder, a link, of no known kind, or not under root."""
    rel = _relative(root, path)
    if rel is None:
        return spark.createDataFrame([], _FILE)
    rows = walk.read_tree(spark, root, files=[rel], most=schema.INDEXED_BYTES).withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")
    return _source_files(rows.where(F.col("length") <= schema.INDEXED_BYTES))


def _relative(root: str, path: str) -> str | None:
    """path, absolute or relative to root, without . and ..; None where it leaves root."""
    if not path or re.search(r"[\x00\r\n]", path):
        return None
    base = posixpath.normpath("/" + root.strip("/"))
    whole = posixpath.normpath(path if path.startswith("/") else f"{base}/{path}")
    return whole[len(base) + 1 :] if whole.startswith(base + "/") else None


def scan_markdown(spark: SparkSession, root: str, limit: int = 500, ignore: list[str] | None = None, exclude: tuple[str, ...] = (), scope: str | None = None) -> DataFrame:
    """(path, text) of the first `limit` markdown files by path, at most READ_BYTES of each: the bounds of a scan at a session's start.

    Hidden folders, those of MARKDOWN_SKIPPED, ignored paths and those under `exclude` (relative folders) are left out;
    scope: a glob that paths must fit. markdown_files() has no bounds.
    """
    rows = walk.read_tree(spark, root, MARKDOWN_SKIPPED, [*(ignore or []), *(f"/{folder.strip('/')}/" for folder in exclude)], hidden=False, only=r"\.md$")
    if scope:
        rows = rows.where(F.col("path").rlike(scope_regex(scope)))
    return rows.orderBy("path").limit(limit).select("path", F.decode(F.substring("content", 1, schema.READ_BYTES), "UTF-8").alias("text"))


def markdown_files(spark: SparkSession, root: str, scope: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, text) of every markdown file of a tree, whole: for full coverage.

    Without a scope: files whose extension is md, whatever its case, but those in hidden folders and those that the
    tree's ignore files (or `ignore`) name. With one: all files whose path fits the glob, of any kind, ignored or not.
    """
    if scope:
        rows = walk.read_tree(spark, root, only=scope_regex(scope) if "**" in scope else segment_glob_regex(scope))
    else:
        rows = walk.read_tree(spark, root, ignore=read_ignore_files(spark, root) if ignore is None else ignore, hidden=False, only=r"(?i)\.md$")
    return rows.select("path", F.decode("content", "UTF-8").alias("text"))


def audit_log(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """JSON lines of flagged edits; lines that are not JSON objects, or longer than LINE_BYTES, are dropped."""
    kind = "session_id string, path string, forbidden bigint, unverified bigint, recorded_at bigint"
    lines = spark.read.text(path).where(F.octet_length("value") <= schema.LINE_BYTES)
    out = lines.select(F.from_json("value", kind + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).where("e IS NOT NULL AND e._bad IS NULL").select("e.*").drop("_bad")
    return out.where(F.col("session_id") == session) if session else out


ENVELOPE = "session_id string, hook_event_name string, tool_name string, cwd string, source string, ts timestamp, tool_input struct<file_path:string,notebook_path:string,new_string:string,content:string,new_source:string,command:string,edits:array<struct<old_string:string,new_string:string>>>"


def decode_events(lines: DataFrame, column: str = "value", most_bytes: int = schema.PAYLOAD_BYTES) -> DataFrame:
    """Event envelopes from JSON text; `malformed` marks those that must be denied: no JSON, or too long. Multi-edits are joined by line ends."""
    e = F.from_json(column, ENVELOPE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("e", e)
    text = F.coalesce("e.tool_input.new_string", "e.tool_input.content", "e.tool_input.new_source", F.array_join(F.transform("e.tool_input.edits", lambda x: x["new_string"]), "\n"), F.lit(""))
    path = F.coalesce("e.tool_input.file_path", "e.tool_input.notebook_path")
    return out.select("e.session_id", F.col("e.hook_event_name").alias("event"), "e.tool_name", "e.ts", path.alias("path"), text.alias("text"), F.col("e.tool_input.command").alias("command"), (F.col("e").isNull() | F.col("e._bad").isNotNull() | (F.octet_length(column) > most_bytes)).alias("malformed"))


def rpc_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are JSON objects with jsonrpc 2.0; others, and those over RPC_BYTES, are dropped, and what follows them counts again."""
    whole = F.octet_length(column) <= schema.RPC_BYTES
    return lines.where(whole & F.startswith(F.ltrim(F.col(column)), F.lit("{")) & (F.get_json_object(column, "$.jsonrpc") == "2.0"))


# ---------------------------------------------------------------- truth files


def flatten(tree, prefix: str = "") -> list[tuple[str, str, str | None, float | None]]:
    """(path, vtype, svalue, nvalue) of the leaves of a tree of maps, lists and scalars."""
    if isinstance(tree, dict):
        return [leaf for k, v in tree.items() for leaf in flatten(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(tree, list):
        return [leaf for i, v in enumerate(tree) for leaf in flatten(v, f"{prefix}[{i}]")]
    if isinstance(tree, bool):
        return [(prefix, "bool", str(tree).lower(), None)]
    if isinstance(tree, (int, float)):
        text = str(int(tree)) if float(tree).is_integer() and abs(tree) < 1e15 else repr(tree)
        return [(prefix, "number", text, float(tree))]
    return [(prefix, "null", None, None)] if tree is None else [(prefix, "date" if re.fullmatch(r"\d{4}-\d\d-\d\d", str(tree)) else "string", str(tree), None)]


def facts_from_yaml(spark: SparkSession, text: str | None) -> DataFrame:
    """The leaves of a facts file; a missing or empty one has none. The root must be a map."""
    tree = yaml.load(text or "")
    if tree is not None and not isinstance(tree, dict):
        raise ValueError("facts: the root must be a map")
    return spark.createDataFrame(flatten(tree or {}), "path string, vtype string, svalue string, nvalue double")


def filters_from_yaml(text: str | None) -> tuple[list[tuple[str, str, list[str]]], list[tuple[str, str, str]]]:
    """(path filters, content filters) as guard.path_filter() and guard.content_filter() take them; entries that are not as they should be are errors."""
    root = yaml.load(text or "") or {}

    def entries(name: str, pattern: str):
        found = root.get(name) or []
        if not isinstance(found, list):
            raise ValueError(f"{name} must be a list")
        for i, e in enumerate(found):
            if not isinstance(e, dict):
                raise ValueError(f"{name}[{i}] must be a map")
            if not isinstance(e.get(pattern), str) or not e[pattern]:
                raise ValueError(f"{name}[{i}]: {pattern} is required and must be a string")
            try:
                re.compile(e[pattern])
            except re.error as x:
                raise ValueError(f"{name}[{i}]: {pattern}: {x}") from None
            yield i, e

    paths = []
    for i, e in entries("path_filters", "path_pattern"):
        values = e.get("forbidden_values") or []
        if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
            raise ValueError(f"path_filters[{i}]: forbidden_values must be a list of strings")
        paths.append((str(e.get("reason") or e["path_pattern"]), e["path_pattern"], values))
    contents = [(str(e.get("required") or ""), e["content_pattern"], str(e.get("required") or "")) for _, e in entries("content_filters", "content_pattern")]
    return paths, contents


def facts_from_json(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(flatten(json.loads(text or "{}")), "path string, vtype string, svalue string, nvalue double")


# What marks a bullet as a statement not to make, what ends its text, and the parts of a story by how their headings begin.
RULE_MARKERS = ("❌", "🚫", "X", "x")
RULE_BREAKS = (" — ", " -- ", " - ")
STORY_PARTS = (("short version", "short"), ("long version", "long"), ("do not drift", "do_not_drift"), ("do-not-drift", "do_not_drift"), ("do not", "do_not_drift"), ("sensitivity", "sensitivity"))
_FUZZ = re.compile(r"^(.*?) *\{\s*fuzz\s*:\s*(exact|\+?\d+)\s*\}$", re.S | re.A)


def _unmarked(bullet: str) -> str | None:
    """What follows a marker that stands alone or before a space; None without one."""
    for mark in RULE_MARKERS:
        if bullet == mark or bullet.startswith(mark + " "):
            return bullet[len(mark) :].strip()
    return None


def _rule(body: str, default_fuzz: int) -> dict:
    """Text, reason and edits forgiven: the reason follows the first kind of break that there is; enclosing straight quotes go."""
    fuzz = default_fuzz
    if m := _FUZZ.match(body):
        body, fuzz = m[1], 0 if m[2] == "exact" else int(m[2])
    mark = next((mark for mark in RULE_BREAKS if mark in body), None)
    text, reason = (x.strip() for x in body.split(mark, 1)) if mark else (body.strip(), "")
    if len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return {"text": text, "reason": reason, "fuzz": fuzz}


def parse_rules(text: str, default_fuzz: int = 1) -> list[dict]:
    """Statements not to make: bullets with a marker, by the second-level heading before them (indented or not).

    A line that begins with two spaces and is no bullet or heading goes on with the last rule's reason. Other bullets and
    prose are left out; a rule without a text is an error that names its line. No text has no rules.
    """
    out: list[dict] = []
    category = ""
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith("## "):
            category = bare[3:].strip()
        elif bare[:2] in ("- ", "* "):
            body = _unmarked(bare[2:].strip())
            if body is None:
                continue
            rule = _rule(body, default_fuzz)
            if not rule["text"]:
                raise ValueError(f"line {number}: a rule needs a text")
            out.append({"ord": len(out) + 1, "category": category, **rule, "line": number})
        elif line.startswith("  ") and bare and out:
            out[-1]["reason"] = f"{out[-1]['reason']} {bare}".strip()
    return out


def parse_stories(text: str) -> dict[str, dict]:
    """Stories by lower-cased name: name, line, short, long, do_not_drift (its bullets), sensitivity (its first line with a word).

    Every second-level heading opens a story; STORY: before its name goes. A later story of the same name replaces one,
    other parts are left out, and a story without a name is an error that names its line.
    """
    out: dict[str, dict] = {}
    story = part = None
    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if bare.startswith("## "):
            name, part = bare[3:].strip().removeprefix("STORY:").strip(), None
            if not name:
                raise ValueError(f"line {number}: a story needs a name")
            story = {"name": name, "line": number, "short": "", "long": "", "do_not_drift": [], "sensitivity": ""}
            out[name.lower()] = story
        elif story is None:
            continue
        elif bare.startswith("### "):
            heading = bare[4:].lower()
            part = next((p for begins, p in STORY_PARTS if heading.startswith(begins)), None)
        elif part in ("short", "long"):
            story[part] += line.removesuffix("\r") + "\n"
        elif part == "do_not_drift" and bare.startswith("- "):
            story[part].append(bare[1:].strip())
        elif part == "sensitivity" and not story[part]:
            story[part] = bare
    for story in out.values():
        story["short"], story["long"] = story["short"].strip(), story["long"].strip()
    return out


def get_story(stories: dict[str, dict], name: str) -> dict:
    """A story by name, whatever the case."""
    found = stories.get(name.strip().lower())
    if found is None:
        raise KeyError(f"no story {name!r}")
    return found


def _parsed(docs: DataFrame, key: str, parse, kind: str) -> DataFrame:
    """A row of `kind` for each thing that parse() finds in each text, with the text's key."""
    import pyarrow as pa

    fields = [c.split() for c in kind.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for at, text in enumerate(b.column(1).to_pylist()):
                found = parse(text or "")
                keys += [at] * len(found)
                rows += found
            columns = [pa.array([row[name] for row in rows], types[of]) for name, of in fields]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *columns], names=[key, *(name for name, _ in fields)])

    src = docs.select(key, "text")
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, {kind}")


def rules_of(docs: DataFrame, key: str = "doc_id", default_fuzz: int = 1) -> DataFrame:
    """(key, ord, category, text, reason, fuzz, line) of the rules in many rule files (key, text); null and empty files have none."""
    kind = "ord int, category string, text string, reason string, fuzz int, line int"
    return _parsed(docs, key, lambda text: parse_rules(text, default_fuzz), kind)


def stories_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, line, short, long, do_not_drift, sensitivity) of the stories in many files (key, text); null and empty files have none."""
    kind = "name string, line int, short string, long string, do_not_drift array<string>, sensitivity string"
    return _parsed(docs, key, lambda text: list(parse_stories(text).values()), kind)
