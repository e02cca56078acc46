"""Symbols of source files, by language, as a table function over (path, language, text).

Python is parsed; Go, TypeScript and Rust are read along their brackets (structure.py); other languages are scanned by
declaration patterns after comments and literals are blanked (lexer.py), with containers found by braces or `end`. A file that cannot be read gives an error row and no symbols.
"""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ET
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from . import lexer, structure

SYMBOL = "path string, ord int, name string, qualified_name string, kind string, signature string, start_line int, end_line int, exported boolean, error string"


def qualifier(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path).replace("/", ".")


def _row(name, qname, kind, signature, start, end, exported):
    return {"name": name, "qualified_name": qname, "kind": kind, "signature": signature, "start_line": start, "end_line": end, "exported": exported, "error": None}


def _shown(name: str) -> bool:
    return not name.startswith("_")


def python(path: str, text: str) -> list[dict]:
    """Top-level functions, classes with one level of methods, and assigned names. A name with a leading underscore is private."""
    prefix, out = qualifier(path), []

    def function(node, container=""):
        a = node.args
        names = [x.arg for x in a.posonlyargs] + ["/"] * bool(a.posonlyargs) + [x.arg for x in a.args]
        names += [f"*{a.vararg.arg}"] if a.vararg else ["*"] * bool(a.kwonlyargs)
        names += [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
        qualified = ".".join(x for x in (prefix, container, node.name) if x)
        out.append(_row(node.name, qualified, "method" if container else "function", f"def {node.name}({', '.join(names)})", node.lineno, node.end_lineno, _shown(node.name)))

    for node in ast.parse(text.removeprefix("\ufeff")).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node)
        elif isinstance(node, ast.ClassDef):
            bases = ", ".join(map(ast.unparse, node.bases))
            out.append(_row(node.name, f"{prefix}.{node.name}", "type", f"class {node.name}" + (f"({bases})" if bases else ""), node.lineno, node.end_lineno, _shown(node.name)))
            for sub in node.body:
                if isinstance(sub, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(sub, node.name)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and target.id != "_":
                    out.append(_row(target.id, f"{prefix}.{target.id}", "var", f"var {target.id}", node.lineno, node.end_lineno, _shown(target.id)))
    return out


def _d(kind: str, pattern: str, container: bool = False):
    return kind, re.compile(pattern, re.M), container


_N = r"([A-Za-z_$][\w$]*)"
_MOD = r"(?:^|(?<=[{};]))[ \t]*(?:(?:export|default|declare|public|private|fileprivate|protected|internal|static|final|abstract|sealed|open|override|async|readonly|partial|virtual|inline|unsafe|const|extern|data|suspend|case|implicit|lazy|external|mutating|required|convenience|enum|annotation|value|inner|companion|operator|infix|tailrec)\s+)*"
_NOT_CALL = r"(?!(?:if|for|while|switch|catch|return|new|else|throw|do|foreach|using|lock|synchronized|await|assert|super|this|function)\b)"


class Language:
    """How declarations of a language are found. containers: where a method's owner comes from; braces, or `end` at its own indentation.

    inside: functions in a container are methods. exported: whether functions are without a modifier that says so.
    """

    def __init__(self, exported: bool, declarations: list, ends: str = "brace", inside: bool = False):
        self.exported, self.declarations, self.ends, self.inside = exported, declarations, ends, inside


#: The languages that are scanned by patterns. In a declaration the last group is the name; true: a container.
LANGUAGES = {
    "java": Language(False, [_d("type", rf"{_MOD}(?:class|record|enum)\s+{_N}", True), _d("interface", rf"{_MOD}(?:interface|@interface)\s+{_N}", True), _d("method", rf"^[ \t]+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?{_NOT_CALL}{_N}\s*\([^)]*\)\s*(?:throws [\w, .]+)?[{{;]")]),
    "csharp": Language(False, [_d("type", rf"{_MOD}(?:class|struct|record(?:\s+struct|\s+class)?|enum)\s+{_N}", True), _d("type", rf"{_MOD}delegate\s+[\w<>\[\],.?]+\s+{_N}"), _d("interface", rf"{_MOD}interface\s+{_N}", True), _d("method", rf"^[ \t]+(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed|partial|extern|new|unsafe)\s+)*(?:[\w<>\[\],.?]+\s+)?{_NOT_CALL}{_N}\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where [^{{;]+)?(?:\{{|=>|;)")]),
    "kotlin": Language(True, [_d("type", rf"{_MOD}(?:class|object|interface)\s+{_N}", True), _d("method", rf"{_MOD}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?{_N}")]),
    "swift": Language(True, [_d("type", rf"{_MOD}(?:class|struct|enum|actor|extension)\s+(?!func\b|var\b|let\b){_N}", True), _d("interface", rf"{_MOD}protocol\s+{_N}", True), _d("function", rf"{_MOD}(?:class\s+)?func\s+{_N}"), _d("method", rf"{_MOD}(init)[?!]?\s*[(<]")]),
    "scala": Language(True, [_d("type", rf"{_MOD}(?:class|object)\s+{_N}", True), _d("interface", rf"{_MOD}trait\s+{_N}", True), _d("method", rf"{_MOD}def\s+{_N}")]),
    "dart": Language(True, [_d("type", rf"{_MOD}(?:class|mixin)\s+{_N}", True), _d("function", rf"^[ \t]*(?:(?:static|external|abstract|override)\s+)*{_NOT_CALL}[\w<>?,]+\s+{_NOT_CALL}{_N}\s*\([^)]*\)\s*(?:async\*?\s*|sync\*\s*)?(?:[{{;]|=>)")]),
    "c": Language(True, [_d("function", rf"^[A-Za-z_][\w \t*]*?[ \t*]{_NOT_CALL}{_N}\s*\([^;{{]*\)\s*\{{"), _d("type", rf"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+{_N}\s*\{{", True), _d("type", rf"^[ \t]*(?:typedef\s+)?enum\s+{_N}\s*\{{"), _d("type", r"^\}\s*([A-Za-z_]\w*)\s*;"), _d("type", r"^typedef\s+[^;{}()]*?[\s*]([A-Za-z_]\w*)\s*;")]),
    "cpp": Language(False, [_d("type", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+{_N}\b[^;\n(]*\{{", True), _d("type", rf"^[ \t]*(?:inline\s+)?namespace\s+{_N}\s*\{{", True), _d("type", rf"^[ \t]*enum(?:\s+class|\s+struct)?\s+{_N}[^;\n]*\{{"), _d("type", r"^\}\s*([A-Za-z_]\w*)\s*;"), _d("function", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?[A-Za-z_][\w \t*&<>:,]*?[ \t*&:]{_NOT_CALL}{_N}\s*\([^;{{]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{{"), _d("method", rf"^[ \t]+[A-Za-z_][\w \t*&<>:,]*?[ \t*&]{_NOT_CALL}{_N}\s*\([^;{{]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?:=\s*0\s*)?;")], inside=True),
    "php": Language(True, [_d("type", r"^[ \t]*namespace\s+([\w\\]+)"), _d("type", rf"{_MOD}(?:class|trait)\s+{_N}", True), _d("type", rf"{_MOD}enum\s+{_N}"), _d("interface", rf"{_MOD}interface\s+{_N}", True), _d("function", rf"{_MOD}function\s+&?\s*{_N}")], inside=True),
    "solidity": Language(False, [_d("type", rf"^[ \t]*(?:abstract\s+)?(?:contract|library)\s+{_N}", True), _d("interface", rf"^[ \t]*interface\s+{_N}", True), _d("method", rf"^[ \t]*(?:function|modifier|event)\s+{_N}(?:\s*\([^)]*\)[^{{;]*)?"), _d("method", r"^[ \t]*(constructor)\s*\([^)]*\)[^{;]*")]),
    "graphql": Language(True, [_d("type", rf"^(?:extend\s+)?type\s+{_N}", True), _d("type", rf"^(?:extend\s+)?(?:enum|scalar|union|input)\s+{_N}"), _d("interface", rf"^(?:extend\s+)?interface\s+{_N}", True), _d("method", rf"^[ \t]+{_N}\s*(?:\([^)]*\))?\s*:")]),
    "proto": Language(True, [_d("type", rf"^[ \t]*message\s+{_N}", True), _d("type", rf"^[ \t]*enum\s+{_N}"), _d("interface", rf"^[ \t]*service\s+{_N}", True), _d("method", rf"(?:^|[{{;])[ \t]*rpc\s+{_N}")]),
    "wit": Language(True, [_d("interface", r"^[ \t]*interface\s+([\w-]+)", True), _d("type", r"^[ \t]*world\s+([\w-]+)", True), _d("type", r"^[ \t]*(?:record|enum|variant|flags)\s+([\w-]+)"), _d("method", r"^[ \t]*(?:export\s+|import\s+)?([\w-]+)\s*:\s*(?:async\s+)?func\b")]),
    "zig": Language(False, [_d("function", rf"^[ \t]*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+{_N}"), _d("type", rf"^[ \t]*(?:pub\s+)?const\s+{_N}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b")]),
    "glsl": Language(True, [_d("function", rf"^[A-Za-z_]\w*\s+{_N}\s*\([^;{{]*\)\s*(?::\s*\w+\s*)?\{{"), _d("type", rf"^struct\s+{_N}"), _d("const", rf"^(?:layout\s*\([^)]*\)\s*)?(?:(?:uniform|varying|in|out|const|static|attribute|highp|mediump|lowp|flat)\s+)*(?!struct\b|return\b|void\b|float\b|int\b|uint\b|bool\b|double\b|precision\b|cbuffer\b)[A-Za-z_]\w*\s+{_N}\s*(?:\[[^\]]*\]\s*)?(?:=[^;]*)?(?::\s*\w+(?:\([^)]*\))?\s*)?;")]),
    "hcl": Language(True, [_d("type", r'^[ \t]*(?:resource|variable|module|output|data|provider|locals|terraform)[ \t]+"([^"\n]*)"')]),
    "ruby": Language(True, [_d("type", r"^[ \t]*(?:class|module)\s+(?:\w+::)*([A-Z]\w*)", True), _d("method", r"^[ \t]*(?:private\s+|public\s+|protected\s+)?def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")], "end"),
    "elixir": Language(True, [_d("type", r"^[ \t]*defmodule\s+([\w.]+)"), _d("interface", r"^[ \t]*defprotocol\s+([\w.]+)"), _d("method", r"^[ \t]*(?:defp?|defmacro)\s+([a-z_]\w*[?!]?)\s*\(")]),
    "lua": Language(True, [_d("method", r"^[ \t]*function\s+(?:\w+\.)*\w+[.:](\w+)\s*\("), _d("function", r"^[ \t]*(?:local\s+)?function\s+(\w+)\s*\(")]),
    "bash": Language(True, [_d("function", r"^[ \t]*(?:function\s+)?([\w-]+)\s*\(\)\s*\{?"), _d("function", r"^[ \t]*function\s+([\w-]+)\s*\{")]),
    "nix": Language(True, [_d("function", r"^[ \t]*([\w-]+)\s*=\s*(?:\{[^}]*\}(?:\s*@\s*\w+)?|\w+(?:\s*@\s*\{[^}]*\})?)\s*:")]),
    "make": Language(True, [_d("const", r"^(?:export\s+)?([\w.-]+)\s*[:?+]{0,2}=(?!=)"), _d("function", r"^([\w./%-]+)(?:[ \t]+[\w./%-]+)*\s*:{1,2}(?![=:])")]),
    "cmake": Language(True, [_d("function", r"(?i)^[ \t]*function\s*\(\s*(\w+)"), _d("type", r"^[ \t]*(?:add_library|add_executable|option)\s*\(\s*([\w.-]+)")]),
    "sql": Language(True, [_d("type", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?:\w+\.)?[\"`]?(\w+)", True), _d("type", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:(?:temp(?:orary)?|materialized|unique)\s+)*(?:view|index(?:\s+concurrently)?)\s+(?:if\s+not\s+exists\s+)?(?:\w+\.)?[\"`]?(\w+)"), _d("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+(?:\w+\.)?[\"`]?(\w+)")]),
    "erlang": Language(False, [_d("type", r"^-module\((\w+)\)"), _d("type", r"^-record\((\w+)"), _d("function", r"^([a-z]\w*)\s*\([^\n]*?(?:->|\bwhen\b)")]),
    "r": Language(True, [_d("function", r"^[ \t]*([\w.]+)\s*<-\s*function\b")]),
    "just": Language(True, [_d("const", r"^(?:export\s+)?(\w[\w-]*)\s*:="), _d("function", r"^@?(\w[\w-]*)[^:=\n]*:(?!=)")]),
    "starlark": Language(True, [_d("function", r"^def\s+(\w+)"), _d("type", r"(?<=[(,\s])name\s*=\s*\"([^\"\n]*)\"")]),
}
LANGUAGES["hlsl"] = LANGUAGES["glsl"]
#: Declarations whose name lies in a string: they are sought in the text itself.
_IN_TEXT = {"hcl", "starlark"}
_SHOWN = {"public", "open", "export", "pub", "extern", "external", "internal"}
_HIDDEN = {"private", "fileprivate"}
_COLUMN = re.compile(r"\s*[\"`]?([A-Za-z_]\w*)[\"`]?\s+[A-Za-z]")
_NO_COLUMN = {"primary", "foreign", "unique", "constraint", "check", "key", "index", "exclude", "like"}


def scan(path: str, text: str, language: str) -> list[dict]:
    """Declarations by pattern, in the text with comments and strings blanked. Functions are named after the container around them."""
    spec, prefix = LANGUAGES[language], qualifier(path)
    clean = lexer.blank(text, language)
    named = lexer.blank(text, language, strings=False) if language in _IN_TEXT else clean
    found = []
    for order, (kind, pattern, container) in enumerate(spec.declarations):
        for m in pattern.finditer(named):
            group = m.lastindex
            found.append((m.start(group), order, kind, text[m.start(group) : m.end(group)].strip(), m, container))
    found.sort(key=lambda f: (f[0], f[1]))
    out, stack, seen = [], [], set()
    line = line_index(text)
    for at, _, kind, name, m, container in found:
        if at in seen or not name:
            continue
        seen.add(at)
        while stack and at >= stack[-1][1]:
            stack.pop()
        end = _end(clean, m.end()) if spec.ends == "brace" else _indented_end(clean, m.start(), m.end())
        name = "init" if language in ("swift", "solidity") and name in ("init", "constructor") and kind == "method" else name
        owner = stack[-1][0] if stack and kind in ("method", "function", "const") else ""
        if container:
            stack.append((name, end, m[0]))
        namespace = bool(stack) and not container and "namespace" in stack[-1][2].split()
        if kind == "function" and owner and (spec.inside and not namespace or language == "swift" and "protocol" in stack[-1][2].split()):
            kind = "method"
        words = set(re.findall(r"[a-z]+", m[0]))
        exported = True if words & _SHOWN else False if words & _HIDDEN or kind == "const" else spec.exported if kind in ("method", "function") else True
        start = line(at)
        signature = f"fn {name}()" if kind in ("method", "function") else f"{kind} {name}"
        out.append(_row(name, ".".join(x for x in (prefix, owner, name) if x), kind, signature, start, max(start, line(max(end - 1, 0))), exported))
        if language == "sql" and container:
            out += _columns(text, clean, m.end(), prefix, name, line)
    return out


def line_index(text: str):
    """A function from places of a text to their lines, from 1 on; the text is read once."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(ends, at) + 1


def _columns(text: str, clean: str, at: int, prefix: str, table: str, line_of) -> list[dict]:
    """The columns in the parentheses of a table that is created."""
    first = clean.find("(", at)
    if first < 0 or clean[at:first].strip(" \t\n\"`"):
        return []
    out, depth, begin = [], 0, first + 1
    for i in range(first, len(clean)):
        c = clean[i]
        depth += (c == "(") - (c == ")")
        if depth == 1 and c == "," or not depth:
            m = _COLUMN.match(text, begin, i)
            if m and m[1].lower() not in _NO_COLUMN:
                line = line_of(m.start(1))
                out.append(_row(m[1], f"{prefix}.{table}.{m[1]}", "const", f"const {m[1]}", line, max(line, line_of(max(i - 1, 0))), False))
            begin = i + 1
        if not depth:
            break
    return out


def _end(text: str, at: int) -> int:
    """Where the brace block that opens on this declaration closes; its own line's end without one."""
    line = text.find("\n", at)
    line = len(text) if line < 0 else line
    brace = text.find("{", max(0, at - 1), line + 1)
    if brace < 0 and (m := re.compile(r"\s*\{").match(text, line)):
        brace = m.end() - 1
    if brace < 0 or ";" in text[at:brace]:
        return line
    depth = 0
    for m in re.finditer(r"[{}]", text[brace:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return brace + m.end()
    return len(text)


def _indented_end(text: str, start: int, at: int) -> int:
    """Behind the `end` that stands where the declaration's line begins; its own line's end without one."""
    line = text.rfind("\n", 0, start + 1) + 1
    indent = re.compile(r"[ \t]*").match(text, max(line, start))[0]
    m = re.compile(rf"^{indent}end\b", re.M).search(text, at)
    stop = text.find("\n", at)
    return m.end() if m else len(text) if stop < 0 else stop


_SCRIPT = re.compile(r"<script\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>(.*?)</script\s*>", re.S | re.I)


def script_blocks(text: str) -> list[tuple[int, str]]:
    """(lines before, content) of script blocks outside comments."""
    clean = re.sub(r"<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    return [(text.count("\n", 0, m.start(1)), m[1]) for m in _SCRIPT.finditer(clean)]


def markup(path: str, text: str) -> list[dict]:
    blocks = script_blocks(text)
    if path.endswith(".astro") and (m := re.match(r"\s*---\n(.*?)\n---", text, re.S)):
        blocks = [(text.count("\n", 0, m.start(1)), m[1]), *blocks]
    out = []
    for lines, content in blocks:
        for r in structure.typescript(qualifier(path), content):
            out.append(r | {"start_line": r["start_line"] + lines, "end_line": r["end_line"] + lines})
    return out


def jupyter(path: str, text: str) -> list[dict]:
    cells = [c for c in json.loads(text).get("cells", []) if c.get("cell_type") == "code"]
    return python(path, "\n".join("".join(s) if isinstance(s := c.get("source", ""), list) else s for c in cells))


def _dependency(path, name, version, shown=""):
    return _row(name, f"{qualifier(path)}.{name}", "dependency", f"dependency {shown or name}" + (f"@{version}" if version else ""), 1, 1, True)


def package_json(path: str, text: str) -> list[dict]:
    tree = json.loads(text)
    out = []
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, v in sorted((tree.get(section) or {}).items()):
            out.append(_dependency(path, name, v if isinstance(v, str) else v.get("version") or "" if isinstance(v, dict) else ""))
    return out


def cargo(path: str, text: str) -> list[dict]:
    import tomllib

    tree = tomllib.loads(text)
    out = []
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, v in sorted((tree.get(section) or {}).items()):
            out.append(_dependency(path, name, v if isinstance(v, str) else v["version"] if isinstance(v.get("version"), str) else "path" if "path" in v else "git" if "git" in v else ""))
    return out


def go_mod(path: str, text: str) -> list[dict]:
    out = []
    body = re.sub(r"require\s*\(([^)]*)\)", lambda m: "\n".join("require " + x.strip() for x in m[1].splitlines() if x.strip()), text)
    for m in re.finditer(r"^require\s+(\S+)\s+(\S+)([ \t]*//[ \t]*indirect)?", body, re.M):
        row = _dependency(path, m[1].strip('"'), m[2])
        out.append(row | {"signature": row["signature"] + (" (indirect)" if m[3] else "")})
    return out


def maven(path: str, text: str) -> list[dict]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    pick = lambda d, t: (d.findtext(t) or "").strip()
    named = lambda d: ":".join(x for x in (pick(d, "groupId"), pick(d, "artifactId")) if x)
    return [_dependency(path, pick(d, "artifactId"), pick(d, "version"), named(d)) for d in root.findall("./dependencies/dependency")]


def openapi(path: str, text: str) -> list[dict]:
    """Operations as methods and schemas as types, of a JSON or YAML document; a document that is no map has none."""
    from ..sources import yaml

    try:
        tree = json.loads(text)
    except ValueError:
        tree = yaml.load(text)
    maps = lambda x: x if isinstance(x, dict) else {}
    tree, module, out = maps(tree), qualifier(path), []
    for route, item in sorted(maps(tree.get("paths")).items()):
        for method in sorted(m for m in maps(item) if m.lower() in HTTP_METHODS):
            name = f"{method.upper()} {route}"
            out.append(_row(name, f"{module}.{name}", "method", f"endpoint {name}", 1, 1, True))
    schemas = maps(tree.get("components")).get("schemas")
    for name in sorted(schemas if isinstance(schemas, dict) else maps(tree.get("definitions"))):
        out.append(_row(name, f"{module}.{name}", "type", f"schema {name}", 1, 1, True))
    return out


# The keys of a path that are operations.
HTTP_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
#: Manifests, by base name.
MANIFESTS = {"package.json": package_json, "cargo.toml": cargo, "go.mod": go_mod, "pom.xml": maven}


def manifest(path: str, text: str) -> list[dict]:
    return MANIFESTS[path.rsplit("/", 1)[-1].lower()](path, text)


EXTRACTORS = {
    "go": lambda path, text: structure.go(text), "typescript": lambda path, text: structure.typescript(qualifier(path), text), "rust": lambda path, text: structure.rust(qualifier(path), text),
    "python": python, "jupyter": jupyter, "vue": markup, "svelte": markup, "astro": markup, "manifest": manifest, "openapi": openapi,
}


def symbols_of(path: str, text: str | None, language: str | None) -> list[dict]:
    try:
        if language in EXTRACTORS:
            return EXTRACTORS[language](path, text or "")
        return scan(path, text or "", language) if language in LANGUAGES else []
    except Exception as e:  # a broken file is a row, not a failed job
        return [dict.fromkeys(("name", "qualified_name", "kind", "signature", "start_line", "end_line", "exported")) | {"error": f"{type(e).__name__}: {e}"[:200]}]


def extract(files: DataFrame) -> DataFrame:
    """SYMBOL rows of files (path, language, text); rows with an error have no symbol. Files are dealt evenly: reading one costs more than its bytes tell."""

    def run(batches):
        for b in batches:
            rows = [r | {"path": p, "ord": k} for p, lang, t in zip(b["path"], b["language"], b["text"]) for k, r in enumerate(symbols_of(p, t, lang))]
            yield pd.DataFrame(rows, columns=["path", "ord", "name", "qualified_name", "kind", "signature", "start_line", "end_line", "exported", "error"]).astype({"ord": "Int32", "start_line": "Int32", "end_line": "Int32", "exported": "boolean"})

    return spread(files.select("path", "language", F.col("text"))).mapInPandas(run, SYMBOL)
