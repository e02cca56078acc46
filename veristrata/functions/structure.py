"""Declarations of TypeScript and Rust files, found along the brackets of a text whose literals are blanked.

A blanked text has the length and lines of the original; comments and the insides of strings are spaces. Its brackets are
paired once, so any group is stepped over in constant time, and what is not at a file's or a type's top level is never seen.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_SPACE = re.compile(r"\s*")


class Structure:
    """A blanked text with its brackets paired."""

    def __init__(self, text: str, clean: str):
        self.text, self.s, self.n = text, clean, len(clean)
        self.lines = [m.end() for m in re.finditer("\n", clean)]
        self.close: dict[int, int] = {}
        open_: list[int] = []
        pair = {")": "(", "]": "[", "}": "{"}
        count = dict.fromkeys("([{", 0)  # of open ones by kind, so that each bracket is looked at once when it opens and once when it goes
        for m in re.finditer(r"[()\[\]{}]", clean):
            c = m[0]
            if c in count:
                open_.append(m.start())
                count[c] += 1
            elif count[pair[c]]:
                while open_:  # a bracket that nothing closes ends with its surroundings
                    i = open_.pop()
                    self.close[i] = m.start()
                    count[clean[i]] -= 1
                    if clean[i] == pair[c]:
                        break
        for i in open_:
            self.close[i] = self.n

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at) + 1

    def space(self, i: int) -> int:
        return _SPACE.match(self.s, i).end()

    def at(self, i: int) -> str:
        return self.s[i] if i < self.n else ""

    def past(self, i: int) -> int:
        """Behind the bracket that opens at i."""
        return min(self.close.get(i, self.n) + 1, self.n)

    def angles(self, i: int) -> int:
        """Behind the <...> that opens at i; behind the < alone if it does not close in this statement."""
        depth, j = 0, i
        while j < self.n:
            c = self.s[j]
            if c in "([{":
                j = self.past(j)
                continue
            if c == "=" and self.at(j + 1) == ">" or c == "-" and self.at(j + 1) == ">":
                j += 2
                continue
            depth += (c == "<") - (c == ">")
            j += 1
            if not depth:
                return j
            if c in ";)]}":
                break
        return i + 1

    def split(self, start: int, end: int) -> list[tuple[int, int]]:
        """The parts between commas that lie in no bracket."""
        out, first, i = [], start, start
        while i < end:
            c = self.s[i]
            if c in "([{":
                i = min(self.past(i), end)
                continue
            if c == "<":
                i = min(self.angles(i), end)
                continue
            if c == ",":
                out.append((first, i))
                first = i + 1
            i += 1
        return [p for p in [*out, (first, end)] if self.s[p[0] : p[1]].strip()]

    def row(self, name: str, qualified: str, kind: str, signature: str, start: int, end: int, exported: bool) -> dict:
        first = self.line(start)
        return {"name": name, "qualified_name": qualified, "kind": kind, "signature": signature, "start_line": first, "end_line": max(first, self.line(max(start, end - 1))), "exported": exported, "error": None}


def _blanked(piece: str, keep: int = 0) -> str:
    """Spaces and line ends; the first and last `keep` characters stay."""
    inner = re.sub(r"[^\n]", " ", piece[keep : len(piece) - keep])
    return piece[:keep] + inner + piece[len(piece) - keep :] if keep and len(piece) >= 2 * keep else re.sub(r"[^\n]", " ", piece)


# ---------------------------------------------------------------- TypeScript

_TS_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[A-Za-z_$][\w$]*|\d[\w.]*|\s+|.", re.S)
_TS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Words after which an expression begins, so that a slash opens a pattern.
_BEFORE_VALUE = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await"}


def blank_typescript(text: str) -> str:
    out, i, value = [], 0, False
    while i < len(text):
        if text[i] == "`":
            end = _template_end(text, i)
            out.append(_blanked(text[i:end], 1))
            i, value = end, True
            continue
        if text[i] == "/" and not value and (m := _TS_REGEX.match(text, i)):
            out.append(_blanked(m[0]))
            i, value = m.end(), True
            continue
        m = _TS_TOKEN.match(text, i)
        piece, i = m[0], m.end()
        if piece.startswith(("//", "/*")):
            out.append(_blanked(piece))
        elif piece[0] in "\"'":
            whole = len(piece) > 1 and piece[-1] == piece[0]  # else it ends with its line
            out.append(_blanked(piece, 1) if whole else "0" + _blanked(piece[1:]))
            value = True
        else:
            out.append(piece)
            if not piece.isspace():
                value = piece in ")]" or (piece[0].isalnum() or piece[0] in "_$") and piece not in _BEFORE_VALUE
    return "".join(out)


def _template_end(text: str, i: int) -> int:
    """Behind the template that opens at i, with what it embeds."""
    i += 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                m = _TS_TOKEN.match(text, i)
                depth += (m[0] == "{") - (m[0] == "}")
                i = m.end()
        else:
            i += 1
    return len(text)


_TS_HEAD = re.compile(r"((?:(?:export|default|declare|async|abstract)\s+)*)(function|class|interface|type|const\s+enum|enum|namespace|module|global|const|let|var|import)\b(?!\s*[=:.,?)])")
_TYPE_PREFIX = re.compile(r"(?:keyof|typeof|readonly|unique|infer|asserts|abstract|new)\b(?=\s+[\w({\[$\"'])")
_MEMBER_MODIFIER = re.compile(r"(?:public|private|protected|static|async|readonly|abstract|override|declare|get|set|accessor)\b(?=\s+[\w$#\[*\"'])|\*")
_PARAMETER_MODIFIER = re.compile(r"(?:public|private|protected|readonly|override)\b(?=\s+[\w$\[{])")


class TypeScript:
    """Top-level functions, classes with their methods, interfaces, type aliases and variables."""

    def __init__(self, prefix: str, text: str):
        self.t, self.prefix, self.out = Structure(text, blank_typescript(text)), prefix, []

    def add(self, name, kind, signature, start, end, exported, owner=""):
        self.out.append(self.t.row(name, ".".join(x for x in (self.prefix, owner, name) if x), kind, signature, start, end, exported))

    def outline(self) -> list[dict]:
        t, i = self.t, 0
        while (i := t.space(i)) < t.n:
            m = _TS_HEAD.match(t.s, i)
            if m:
                i = max(self.declaration(m), m.end(2) if m[2] != "import" else m.end())
            elif t.s[i] in "([{":
                i = t.past(i)
            elif t.s[i] == ".":
                word = _IDENT.match(t.s, t.space(i + 1))
                i = word.end() if word else i + 1
            else:
                word = _IDENT.match(t.s, i)
                i = word.end() if word else i + 1
        return self.out

    def declaration(self, m) -> int:
        t, kind, start, i = self.t, m[2], m.start(), m.end()
        exported = "export" in m[1].split()
        if kind in ("const", "let", "var"):
            return self.variables(kind, start, i, exported)
        if kind == "import":
            return self.statement_end(i)
        if kind in ("namespace", "module", "global", "enum") or kind.startswith("const"):
            return self.body(i)[1]
        i = t.space(i)
        if kind == "function" and t.at(i) == "*":
            i = t.space(i + 1)
        word = _IDENT.match(t.s, i)
        if not word or kind in ("class", "interface") and word[0] in ("extends", "implements"):
            return i
        name, i = word[0], t.space(word.end())
        if t.at(i) == "<":
            i = t.space(t.angles(i))
        if kind == "function":
            if t.at(i) != "(":
                return i
            names, end = self.parameters(i), self.callable_end(i)
            self.add(name, "function", f"function {name}({names})", start, end, exported)
            return end
        if kind == "type":
            if t.at(i) != "=":
                return i
            end = self.type_end(i + 1)
            self.add(name, "type", f"type {name}", start, end, exported)
            return end + 1 if t.at(end) == ";" else end
        first, end = self.body(i)
        if kind == "interface":
            self.add(name, "interface", f"interface {name}", start, end, exported)
        else:
            self.add(name, "type", f"class {name}", start, end, exported)
            if first:
                self.members(name, first + 1, end - 1, exported)
        return end

    def body(self, i: int) -> tuple[int, int]:
        """Where the { of a declaration is, and behind its }; heritage clauses may have calls and type arguments of their own."""
        t = self.t
        while i < t.n:
            c = t.s[i]
            if c == "{":
                return i, t.past(i)
            if c in "([":
                i = t.past(i)
            elif c == "<":
                i = t.angles(i)
            elif c in ";}":
                break
            else:
                i += 1
        return 0, i

    def parameters(self, i: int) -> str:
        """Names of the parameters in the parentheses at i."""
        t, names = self.t, []
        for a, b in t.split(i + 1, t.close.get(i, t.n)):
            a = self.decorators(t.space(a))
            while m := _PARAMETER_MODIFIER.match(t.s, a):
                a = t.space(m.end())
            rest = "..." if t.s.startswith("...", a) else ""
            a = t.space(a + len(rest))
            word = _IDENT.match(t.s, a)
            if word and word.end() <= b:
                names.append(rest + word[0])
            elif t.at(a) in ("{", "["):
                names.append(rest + {"{": "{...}", "[": "[...]"}[t.at(a)])
        return ", ".join(names)

    def decorators(self, i: int) -> int:
        t = self.t
        while t.at(i) == "@":
            word = re.compile(r"@\s*[\w$]+(?:\s*\.\s*[\w$]+)*").match(t.s, i)
            i = word.end() if word else i + 1
            if t.at(i) == "(":
                i = t.past(i)
            i = t.space(i)
        return i

    def callable_end(self, i: int) -> int:
        """Behind a function whose parameters are in the parentheses at i: its return type, and its body or semicolon."""
        t = self.t
        i = t.space(t.past(i))
        if t.at(i) == ":":
            i = t.space(self.type_end(i + 1))
        if t.at(i) == "{":
            return t.past(i)
        return i + 1 if t.at(i) == ";" else i

    def type_end(self, i: int) -> int:
        """Behind the type that begins at i."""
        t = self.t
        while True:
            i = t.space(i)
            while m := _TYPE_PREFIX.match(t.s, i):
                i = t.space(m.end())
            c = t.at(i)
            if c in ("|", "&"):
                i += 1
                continue
            if c == "<":  # a generic function type
                i = t.space(t.angles(i))
                c = t.at(i)
            if c and c in "([{":
                i = t.past(i)
            elif c and c in "\"'`":
                i = t.s.find(c, i + 1) + 1 or t.n
            elif word := re.compile(r"-?[\w$.]+").match(t.s, i):
                i = word.end()
            else:
                return i
            while True:
                j = t.space(i)
                c = t.at(j)
                if c == "<":
                    i = t.angles(j)
                elif c == "[" and "\n" not in t.s[i:j]:
                    i = t.past(j)
                elif c == "." and (word := _IDENT.match(t.s, t.space(j + 1))):
                    i = word.end()
                else:
                    break
            word = re.compile(r"=>|[|&?]|(?:is|extends)\b").match(t.s, j)
            if word:
                i = word.end()
            elif c == ":" and self.conditional(i):
                i = j + 1
            else:
                return i

    def conditional(self, i: int) -> bool:
        """Whether a colon behind i belongs to a conditional type that its statement opened."""
        back = max(self.t.s.rfind(x, 0, i) for x in ";{}")
        return bool(re.search(r"\bextends\b[^:]*\?[^:]*$", self.t.s[back + 1 : i]))

    def statement_end(self, i: int, comma: bool = False) -> int:
        """Behind an expression statement: at a semicolon, at a comma if asked, or at a line end after which none goes on."""
        t, last = self.t, ""
        while i < t.n:
            c = t.s[i]
            if c in "([{":
                i, last = t.past(i), ")"
                continue
            if c == ";":
                return i + 1
            if c in ")]}" or comma and c == ",":
                return i
            if c == "\n":
                j = t.space(i)
                word = _IDENT.match(t.s, j)
                goes_on = last in tuple("=+-*/%&|^<>?:,.!~") or t.at(j) in tuple(".?:+-*/%&|^<>=,") or word and word[0] in ("in", "instanceof", "of", "as", "satisfies")
                if not goes_on and last or j >= t.n:
                    return i
                i = j
                continue
            if not c.isspace():
                last = c
            i += 1
        return i

    def arrow(self, i: int) -> tuple[str, int] | None:
        """(parameter names, end) of the arrow function that begins at i, if one does."""
        t = self.t
        if m := re.compile(r"async\b(?=\s*[\w$(<])").match(t.s, i):
            i = t.space(m.end())
        if t.at(i) == "<":
            i = t.space(t.angles(i))
        if t.at(i) == "(":
            names, j = self.parameters(i), t.space(t.past(i))
            if t.at(j) == ":":
                j = t.space(self.arrow_type_end(j + 1))
        elif word := _IDENT.match(t.s, i):
            names, j = word[0], t.space(word.end())
        else:
            return None
        if not t.s.startswith("=>", j):
            return None
        j = t.space(j + 2)
        return names, t.past(j) if t.at(j) == "{" else self.statement_end(j, comma=True)

    def arrow_type_end(self, i: int) -> int:
        """Behind an arrow function's return type: the last arrow of a run is the function's own."""
        t, end = self.t, self.type_end(i)
        at = t.s.rfind("=>", i, end)
        return at if at >= 0 and not t.s.startswith("=>", t.space(end)) else end

    def variables(self, kind: str, start: int, i: int, exported: bool) -> int:
        t = self.t
        while True:
            i = t.space(i)
            word = _IDENT.match(t.s, i)
            if not word:
                if t.at(i) not in ("{", "["):
                    return i
                i = t.past(i)  # a pattern; its names are not listed
            else:
                i = word.end()
            i = t.space(i + 1) if t.at(t.space(i)) == "!" else t.space(i)
            if t.at(i) == ":":
                i = t.space(self.type_end(i + 1))
            found = None
            if t.at(i) == "=" and t.at(i + 1) != ">":
                i = t.space(i + 1)
                found = self.arrow(i)
                i = found[1] if found else self.statement_end(i, comma=True)
            if word:
                name = word[0]
                signature = f"function {name}({found[0]})" if found else f"{kind} {name}"
                end = i - 1 if t.s[i - 1 : i] == ";" else i
                self.add(name, "function" if found else "const" if kind == "const" else "var", signature, start, end, exported)
            j = t.space(i)
            if t.at(j) != ",":
                return j + 1 if t.at(j) == ";" else i
            i = j + 1

    def members(self, owner: str, i: int, end: int, exported: bool) -> None:
        t = self.t
        while (i := t.space(i)) < end:
            start = i
            i = self.decorators(i)
            while m := _MEMBER_MODIFIER.match(t.s, i):
                i = t.space(m.end())
            if t.at(i) == "{" or t.s.startswith("static", i) and t.at(t.space(i + 6)) == "{":
                i = t.past(t.s.index("{", i))  # a block that initialises the class
                continue
            name = ""
            if word := re.compile(r"#?[A-Za-z_$][\w$]*|\d+").match(t.s, i):
                name, i = word[0], word.end()
            elif t.at(i) == "[":
                i = t.past(i)
            elif t.at(i) and t.at(i) in "\"'`":
                i = t.s.find(t.at(i), i + 1) + 1 or t.n
            i = t.space(i)
            if t.at(i) in ("?", "!"):
                i = t.space(i + 1)
            if t.at(i) == "<":
                i = t.space(t.angles(i))
            if t.at(i) == "(":
                names, i = self.parameters(i), self.callable_end(i)
                if name and not name[0].isdigit():
                    self.add(name, "method", f"{name}({names})", start, i, exported, owner)
                continue
            if t.at(i) == ":":
                i = t.space(self.type_end(i + 1))
            if t.at(i) == "=":
                i = self.statement_end(i + 1)
            elif t.at(i) == ";":
                i += 1
            elif i == start:
                i += 1


def typescript(prefix: str, text: str) -> list[dict]:
    return TypeScript(prefix, text).outline()


# ---------------------------------------------------------------- Rust

_RUST_LITERAL = re.compile(r"//[^\n]*|/\*|b?r(#*)\".*?\"\1|b?\"(?:[^\"\\]|\\.)*\"?|b?'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'", re.S)


def blank_rust(text: str) -> str:
    out, i = [], 0
    while m := _RUST_LITERAL.search(text, i):
        end = m.end()
        if m[0] == "/*":  # these nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = len(text) if depth else end
        if i < m.start() or not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_") or m[0][0] in "/\"'":
            out += [text[i : m.start()], _blanked(text[m.start() : end])]
            i = end
    return "".join([*out, text[i:]])


_RUST_VISIBLE = re.compile(r"pub\b(\s*\([^)]*\))?")
_RUST_FN = re.compile(r"((?:(?:default|const|async|unsafe|safe)\s+|extern\s+)*)fn\s+((?:r#)?\w+)")
_RUST_ITEM = re.compile(r"(struct|enum|union|trait|type|const|static|impl|mod|use|extern|macro_rules!|macro)(?![\w!])|macro_rules!")


class Rust:
    """Items of a file, and the functions of its impl blocks; modules inside it are not entered."""

    def __init__(self, prefix: str, text: str):
        self.t, self.prefix, self.out = Structure(text, blank_rust(text)), prefix, []

    def outline(self) -> list[dict]:
        self.items(0, self.t.n, "")
        return self.out

    def items(self, i: int, end: int, owner: str) -> None:
        t = self.t
        while (i := t.space(i)) < end:
            if t.s[i] == "#":  # an attribute
                j = t.space(i + 1)
                j = t.space(j + 1) if t.at(j) == "!" else j
                i = t.past(j) if t.at(j) == "[" else i + 1
                continue
            start = i
            public = False
            if m := _RUST_VISIBLE.match(t.s, i):
                public, i = not m[1], t.space(m.end())
            if m := re.compile(r"unsafe\s+(?=trait|impl|extern|mod)|auto\s+(?=trait)|default\s+(?=impl|type|const)").match(t.s, i):
                i = m.end()
            if m := _RUST_FN.match(t.s, i):
                i = self.function(m, start, public, owner)
            elif (m := _RUST_ITEM.match(t.s, i)) and not owner:
                i = self.item(m, start, public)
            else:
                i = max(self.past_item(i), start + 1)

    def past_item(self, i: int) -> int:
        """Behind the { } or ; that ends an item."""
        t = self.t
        while i < t.n:
            c = t.s[i]
            if c == "{":
                return t.past(i)
            if c in "([":
                i = t.past(i)
                continue
            i += 1
            if c == ";":
                return i
            if c in ")]}":
                return i
        return i

    def function(self, m, start: int, public: bool, owner: str) -> int:
        t, name = self.t, m[2].removeprefix("r#")
        i = t.space(m.end())
        if t.at(i) == "<":
            i = t.space(t.angles(i))
        if t.at(i) != "(":
            return max(self.past_item(i), m.end())
        names = []
        for a, b in t.split(i + 1, t.close.get(i, t.n)):
            part = re.sub(r"^(?:\s*#\s*\[[^\]]*\])+", "", t.s[a:b]).strip()
            pattern = part.split(":", 1)[0].strip() if not re.match(r"[^:]*::", part) else "?"
            if re.fullmatch(r"(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self", pattern):
                names.append("self")
            else:
                word = re.fullmatch(r"(?:ref\s+)?(?:mut\s+)?(?:r#)?([A-Za-z_]\w*)", pattern)
                names.append(word[1] if word and word[1] != "_" else "_")
        end = self.signature_end(t.past(i))
        keyword = "async fn" if re.search(r"\basync\b", m[1]) else "fn"
        qualified = ".".join(x for x in (self.prefix, owner, name) if x)
        self.out.append(t.row(name, qualified, "method" if owner else "function", f"{keyword} {name}({', '.join(names)})", start, end, public))
        return end

    def signature_end(self, i: int) -> int:
        """Behind a function's body or semicolon; return types and bounds may hold brackets, of which only a { is the body."""
        t = self.t
        while i < t.n and t.s[i] not in "{;}":
            i = t.past(i) if t.s[i] in "([" else t.angles(i) if t.s[i] == "<" else i + 1
        return t.past(i) if t.at(i) == "{" else i + 1

    def item(self, m, start: int, public: bool) -> int:
        t, what, i = self.t, m[0], self.t.space(m.end())
        if what == "impl":
            return self.implementation(i)
        if what == "extern" and (block := re.compile(r"\s*\{").match(t.s, m.end())):
            return t.past(block.end() - 1)
        if what not in ("struct", "enum", "trait", "type", "const", "static"):
            return self.past_item(i)
        if what == "static" and (w := re.compile(r"mut\s+").match(t.s, i)):
            i = w.end()
        word = re.compile(r"(?:r#)?([A-Za-z_]\w*)").match(t.s, i)
        if not word:
            return max(self.past_item(i), m.end())
        if what in ("const", "static", "type"):
            end = word.end()
            while end < t.n and t.s[end] != ";":
                end = t.past(end) if t.s[end] in "([{" else end + 1
            end = min(end + 1, t.n)
        else:
            end = self.past_item(word.end())
        kind = {"trait": "interface", "const": "const", "static": "var"}.get(what, "type")
        self.out.append(t.row(word[1], ".".join(x for x in (self.prefix, word[1]) if x), kind, f"{what} {word[1]}", start, end, public))
        return end

    def implementation(self, i: int) -> int:
        t = self.t
        if t.at(i) == "<":
            i = t.angles(i)
        start, target = i, i
        while i < t.n and t.s[i] not in "{;":
            if t.s[i] in "([":
                i = t.past(i)
            elif t.s[i] == "<":
                i = t.angles(i)
            elif m := re.compile(r"\bfor\b(?!\s*<)").match(t.s, i):
                i = target = m.end()
            elif m := re.compile(r"\bwhere\b").match(t.s, i):
                i = t.s.find("{", i) if t.s.find("{", i) >= 0 else t.n
            else:
                word = _IDENT.match(t.s, i)
                i = word.end() if word else i + 1
        if t.at(i) != "{":
            return i + 1
        head = t.s[target:i] if target > start else t.s[start:i]
        self.items(i + 1, t.close.get(i, t.n), _target(re.split(r"\bwhere\b", head)[0].strip()))
        return t.past(i)


def _target(head: str) -> str:
    """The name of the type that an impl block is for."""
    if m := re.match(r"&\s*(?:'\w+\s+)?(?:mut\s+)?", head):
        return "&" + _target(head[m.end() :])
    if head.startswith("("):
        return "_tuple"
    if head.startswith("["):
        return "_array" if ";" in head else "_slice"
    if re.match(r"(?:dyn|impl|fn|unsafe|extern)\b|[*!<]", head):
        return "_anon_impl"
    names, depth = [""], 0
    for part in re.findall(r"->|<|>|::|[\w#]+", head):
        depth += (part == "<") - (part == ">")
        if not depth and part == "::":
            names.append("")
        elif not depth and part[0] not in "<>-":
            names[-1] += part.removeprefix("r#")
    return "::".join(n for n in names if n) or "_anon_impl"


def rust(prefix: str, text: str) -> list[dict]:
    return Rust(prefix, text).outline()


# ---------------------------------------------------------------- Go

_GO_LITERAL = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'", re.S)
_GO_ENDS = re.compile(r"[\w\"'`)\]}]|\+\+|--")


def blank_go(text: str) -> str:
    return _GO_LITERAL.sub(lambda m: _blanked(m[0], 0 if m[0].startswith("/") else 1), text)


class Go:
    """Functions, methods, types, constants and variables at a file's top level."""

    def __init__(self, text: str):
        self.t, self.out = Structure(text, blank_go(text)), []
        package = re.compile(r"\s*package\s+([^\W\d]\w*)").match(self.t.s)
        if not package:
            raise ValueError("expected 'package'")
        if any(e >= self.t.n for e in self.t.close.values()):
            raise ValueError("a bracket is not closed")
        self.package, self.start = package[1], package.end()

    def flat(self, start: int, end: int) -> str:
        """The source there, without comments, white space collapsed."""
        return " ".join(self.t.s[start:end].split())

    def add(self, name, kind, signature, start, end, owner=""):
        qualified = ".".join(x for x in (self.package, owner, name) if x)
        self.out.append(self.t.row(name, qualified, kind, signature, start, end, name[:1].isupper()))

    def outline(self) -> list[dict]:
        t, i = self.t, self.start
        head = re.compile(r"(func|type|const|var)\b")
        while (i := t.space(i)) < t.n:
            m = head.match(t.s, i)
            if not m:
                i = t.past(i) if t.s[i] in "([{" else i + 1 if not (w := _WORD.match(t.s, i)) else w.end()
            elif m[1] == "func":
                i = self.function(i, m.end())
            else:
                i = self.group(m[1], t.space(m.end()))
        return self.out

    def fields(self, i: int, brackets: str = "()") -> str:
        """The parameters in the brackets at i."""
        t = self.t
        parts = [self.flat(a, b) for a, b in self.commas(i + 1, t.close[i])]
        return brackets[0] + ", ".join(parts) + brackets[1]

    def commas(self, start: int, end: int) -> list[tuple[int, int]]:
        out, first, i = [], start, start
        while i < end:
            if self.t.s[i] in "([{":
                i = min(self.t.past(i), end)
                continue
            if self.t.s[i] == ",":
                out.append((first, i))
                first = i + 1
            i += 1
        return [p for p in [*out, (first, end)] if self.t.s[p[0] : p[1]].strip()]

    def function(self, start: int, i: int) -> int:
        t, receiver, owner = self.t, "", ""
        i = t.space(i)
        if t.at(i) == "(":
            kind = self.flat(i + 1, t.close[i]).rstrip(", ")
            named = re.match(r"[^\W\d]\w*\s+(?=[*\w(])", kind)
            kind = kind[named.end() :] if named else kind
            receiver, i = f"({kind}) ", t.space(t.past(i))
            found = re.match(r"[(*\s]*([^\W\d]\w*)", kind)
            owner = found[1] if found else ""
        word = _WORD.match(t.s, i)
        if not word:
            return i + 1
        name, i = word[0], t.space(word.end())
        signature = f"func {receiver}{name}"
        if t.at(i) == "[":
            signature += self.fields(i, "[]")
            i = t.space(t.past(i))
        if t.at(i) != "(":
            return i + 1
        signature += self.fields(i)
        end = t.past(i)
        i = self.blanks(end)
        if t.at(i) == "(":
            parts = self.commas(i + 1, t.close[i])
            single = len(parts) == 1 and not re.match(r"(?!(?:chan|func|map|struct|interface)\b)[^\W\d]\w*\s+[\w*\[(.<]", self.flat(*parts[0]))
            signature += " " + (self.flat(*parts[0]) if single else self.fields(i)) if parts else ""
            end = t.past(i)
        elif t.at(i) not in ("{", "\n", ";", ""):
            end = self.type_end(i)
            signature += " " + self.flat(i, end)
        i = self.blanks(end)
        if t.at(i) == "{":
            end = t.past(i)
        self.add(name, "method" if receiver else "function", signature, start, end, owner)
        return end

    def blanks(self, i: int) -> int:
        while self.t.at(i) and self.t.at(i) in " \t\r":
            i += 1
        return i

    def type_end(self, i: int) -> int:
        """Behind the type that begins at i."""
        t = self.t
        while True:
            i = self.blanks(i)
            if t.at(i) in ("*", "~") or t.s.startswith("<-", i):
                i += 2 if t.at(i) == "<" else 1
                continue
            if t.at(i) == "[":  # the element follows
                i = t.past(i)
                continue
            if t.at(i) == "(":
                return t.past(i)
            m = re.compile(r"(chan|map|func|struct|interface)\b").match(t.s, i)
            if not m:
                break
            i = self.blanks(m.end())
            if m[1] in ("struct", "interface"):
                return t.past(i) if t.at(i) == "{" else i
            if m[1] == "map":
                i = t.past(i)
            elif m[1] == "func":
                i = self.blanks(end := t.past(i))
                if t.at(i) in ("{", "\n", ";", ",", ")", "", "="):
                    return end
        m = re.compile(r"[^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)?").match(t.s, i)
        i = m.end() if m else i
        return t.past(i) if t.at(i) == "[" else i

    def statement_end(self, i: int, end: int) -> int:
        """Where a specification ends: at a semicolon, or a line end after something that can end one."""
        t, last = self.t, ""
        while i < end:
            c = t.s[i]
            if c in "([{":
                i, last = t.past(i), ")"
                continue
            if c == ";" or c == "\n" and (_GO_ENDS.fullmatch(last) or last in ("+", "-") and t.s[:i].rstrip().endswith(last * 2)):
                return i
            if not c.isspace():
                last = c
            i += 1
        return min(i, end)

    def group(self, kind: str, i: int) -> int:
        t = self.t
        if t.at(i) != "(":
            end = self.statement_end(i, t.n)
            self.specification(kind, i, end)
            return end
        end, i = t.close[i], i + 1
        while (i := t.space(i)) < end:
            if t.s[i] == ";":
                i += 1
                continue
            stop = self.statement_end(i, end)
            self.specification(kind, i, stop)
            i = max(stop, i + 1)
        return end + 1

    def specification(self, kind: str, i: int, end: int) -> None:
        t = self.t
        word = _WORD.match(t.s, i)
        if not word:
            return
        if kind == "type":
            name, at = word[0], self.blanks(word.end())
            signature = f"type {name}"
            if t.at(at) == "[" and re.match(r"\[\s*[^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*\s+[\w~*(\[]", t.s[at : t.past(at)]):
                signature += self.fields(at, "[]")
                at = self.blanks(t.past(at))
            alias = t.at(at) == "="
            at = t.space(at + 1) if alias else at
            what = re.compile(r"(struct|interface)\s*\{").match(t.s, at)
            body = f"{what[1]}{{...}}" if what and t.past(what.end() - 1) >= len(t.s[:end].rstrip()) else self.flat(at, end)
            signature += (" = " if alias else " ") + body
            self.add(name, "interface" if what and what[1] == "interface" else "type", signature, i, end)
            return
        names = []
        while word:
            names.append(word)
            at = self.blanks(word.end())
            word = _WORD.match(t.s, t.space(at + 1)) if t.at(at) == "," else None
        equal = self.equal_sign(at, end)
        of = self.flat(at, equal)
        for w in names:
            if w[0] != "_":
                self.add(w[0], kind, f"{kind} {w[0]}" + (f" {of}" if of else ""), w.start(), w.end())

    def equal_sign(self, i: int, end: int) -> int:
        while i < end and self.t.s[i] != "=":
            i = self.t.past(i) if self.t.s[i] in "([{" else i + 1
        return min(i, end)


_WORD = re.compile(r"[^\W\d]\w*")


def go(text: str) -> list[dict]:
    return Go(text).outline()
