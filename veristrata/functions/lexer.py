"""One lexer for the literals and comments of many languages, driven by a table: what is blanked never looks like a declaration.

A language is a list of rules, tried in order where the text may begin one: line and block comments (nested or not), quoted
strings (with escapes, doubled quotes, over lines, with holes of code in them), quotations whose delimiter is chosen by the
writer, here-documents, and directives. Holes are lexed as code, with an explicit stack, so a string in a hole in a string
ends where it ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

#: What a span is: a comment; a quotation that may hold a name; text over lines, which never does.
COMMENT, STRING, TEXT = "comment", "string", "text"


@dataclass(frozen=True)
class Rule:
    """begin: an expression. Then one of: end, an expression from behind it on (a missing one is the end of the text); closing, what
    makes that expression from the match; quote, what closes a string that skips `escape` and has holes; nests, what opens a comment again."""

    begin: str
    kind: str
    end: str | None = None
    closing: Callable[[re.Match], str] | None = None
    quote: str | None = None
    escape: str | None = None
    hole: tuple[str, str, str] | None = None  # what opens a hole, and the bracket that opens and closes in it
    lines: bool = False
    nests: str | None = None


def line_comment(mark: str) -> Rule:
    return Rule(mark, COMMENT, end=r"(?=\n)")


def block(begin: str, end: str, nests: bool = False, kind: str = COMMENT) -> Rule:
    return Rule(begin, kind, end=None if nests else end, nests=end if nests else None)


def string(begin: str, quote: str, escape: str | None = r"\\.", hole: tuple[str, str, str] | None = None, lines: bool = False) -> Rule:
    return Rule(begin, TEXT if lines and len(quote) > 1 else STRING, quote=quote, escape=escape, hole=hole, lines=lines)


def chosen(begin: str, closing: Callable[[re.Match], str], kind: str = TEXT) -> Rule:
    return Rule(begin, kind, closing=closing)


_SLASHES, _STARS, _NESTED = line_comment("//"), block(r"/\*", r"\*/"), block(r"/\*", r"\*/", nests=True)
_HASH = line_comment("#")
_DOUBLE, _SINGLE = string('"', '"'), string("'", "'")
#: A quote of one character or escape, so that lifetimes, symbols and separators of digits are left alone.
_CHARACTER = Rule(r"(?<![\w])'(?:\\[^\n][^'\n]*|[^'\\\n])'", STRING, end="")
_DOLLAR = (r"\$\{", "{", "}")
_HASHED = (r"#\{", "{", "}")
_DIRECTIVE = Rule(r"(?m:^)[ \t]*#(?:[^\n\\]|\\.|\\\n)*", COMMENT, end="")
_IF_ZERO = Rule(r"(?m:^)[ \t]*#[ \t]*if[ \t]+0\b", COMMENT, end=r"(?m:^)[ \t]*#[ \t]*(?:endif|else|elif)\b")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _lined(word: str, indented: bool) -> str:
    """Where a here-document's last line ends."""
    return rf"(?m:^){'[ \t]*' if indented else ''}{re.escape(word)}\b"


def heredoc(begin: str, word: int, indented: Callable[[re.Match], bool]) -> Rule:
    """What follows on the opening line is code, but is blanked with the document, which is simpler and never declares."""
    return chosen(begin, lambda m: _lined(m[word], indented(m)))


_SIGIL = chosen(r"~[a-zA-Z]([(\[{<|/\"'])(?!\1\1)", lambda m: re.escape(_PAIRS.get(m[1], m[1])), STRING)
_PERCENT = chosen(r"(?<![\w)\]}])%[qQwWiIrx]?([(\[{<])", lambda m: re.escape(_PAIRS[m[1]]), STRING)
_TRIPLES = (string('"""', '"""', lines=True), string("'''", "'''", lines=True))

#: Rules by language; the first that fits at a place decides.
TABLE: dict[str, tuple[Rule, ...]] = {
    "java": (_SLASHES, _STARS, string('"""', '"""', lines=True), _DOUBLE, _CHARACTER),
    "csharp": (_SLASHES, _STARS, _DIRECTIVE, chosen(r'\$*("{3,})', lambda m: m[1]), string(r'(?:\$@|@\$)"', '"', '""|{{', (r"\{", "{", "}"), True), string('@"', '"', '""', lines=True), string(r'\$"', '"', r"\\.|{{", (r"\{", "{", "}")), _DOUBLE, _CHARACTER),
    "kotlin": (_SLASHES, _NESTED, string('"""', '"""', None, _DOLLAR, True), string('"', '"', hole=_DOLLAR), _CHARACTER),
    "swift": (_SLASHES, _NESTED, chosen(r'(#+)("""|")', lambda m: m[2] + m[1]), string('"""', '"""', r"\\[^(]", (r"\\\(", "(", ")"), True), string('"', '"', r"\\[^(]", (r"\\\(", "(", ")"))),
    "scala": (_SLASHES, _NESTED, string(r'(?<=\w)"""', '"""', None, _DOLLAR, True), string('"""', '"""', None, lines=True), string(r'(?<=\w)"', '"', hole=_DOLLAR), _DOUBLE, _CHARACTER),
    "dart": (_SLASHES, _NESTED, chosen(r"(?<!\w)r('''|\"\"\"|'|\")", lambda m: m[1], STRING), *(string(q, q, hole=_DOLLAR, lines=True) for q in ("'''", '"""')), string("'", "'", hole=_DOLLAR), string('"', '"', hole=_DOLLAR)),
    "c": (_SLASHES, _STARS, _IF_ZERO, _DIRECTIVE, _DOUBLE, _CHARACTER),
    "cpp": (_SLASHES, _STARS, _IF_ZERO, _DIRECTIVE, chosen(r'(?:u8|u|U|L)?R"([^()\\\s]{0,16})\(', lambda m: re.escape(f"){m[1]}\"")), _DOUBLE, _CHARACTER),
    "php": (_SLASHES, line_comment(r"#(?!\[)"), _STARS, block(r"\?>", r"<\?(?:php\b|=)?", kind=TEXT), heredoc(r"<<<[ \t]*(['\"]?)([A-Za-z_]\w*)\1", 2, lambda m: True), string('"', '"', lines=True), string("'", "'", lines=True)),
    "solidity": (_SLASHES, _STARS, _DOUBLE, _SINGLE),
    "graphql": (string('"""', '"""', lines=True), _HASH, _DOUBLE),
    "proto": (_SLASHES, _STARS, _DOUBLE, _SINGLE),
    "wit": (_SLASHES, _NESTED, _DOUBLE),
    "zig": (_SLASHES, Rule(r"\\\\[^\n]*", TEXT, end=""), _DOUBLE, _CHARACTER),
    "glsl": (_SLASHES, _STARS, _IF_ZERO, _DIRECTIVE),
    "hlsl": (_SLASHES, _STARS, _IF_ZERO, _DIRECTIVE, _DOUBLE),
    "hcl": (_HASH, _SLASHES, _STARS, heredoc(r"<<(-?)(\w+)[^\n]*", 2, lambda m: True), string('"', '"', r"\\.|\$\${|%%{", (r"[$%]\{", "{", "}"))),
    "ruby": (
        block(r"(?m:^)=begin\b", r"(?m:^)=end\b[^\n]*"), Rule(r"(?m:^)__END__\s*(?=\n|\Z)", COMMENT, end=r"\Z"), heredoc(r"<<([~-]?)(['\"]?)([A-Z_]\w*)\2[^\n]*", 3, lambda m: bool(m[1])), _HASH, _PERCENT,
        string('"', '"', hole=_HASHED, lines=True), string("'", "'", lines=True), string("`", "`", hole=_HASHED), Rule(r"(?<=[(,=~!&|?:{;\[\n])[ \t]*/(?! )(?:[^/\\\n]|\\.)+/[a-z]*", STRING, end=""),
    ),
    "elixir": (*(string(q, q, hole=_HASHED, lines=True) for q in ('~S"""', '"""', "'''")), _SIGIL, Rule(r"\?\\?[\"'#]", STRING, end=""), _HASH, string('"', '"', hole=_HASHED, lines=True), string("'", "'", hole=_HASHED)),
    "lua": (chosen(r"--\[(=*)\[", lambda m: re.escape(f"]{m[1]}]"), COMMENT), line_comment("--"), chosen(r"\[(=*)\[", lambda m: re.escape(f"]{m[1]}]")), _DOUBLE, _SINGLE),
    "bash": (line_comment(r"(?:(?<=\s)|(?<=^)|(?<=;))#"), heredoc(r"<<(-?)[ \t]*(['\"\\]?)([A-Za-z_]\w*)\2?[^\n]*", 3, lambda m: bool(m[1])), string(r"\$'", "'", lines=True), string("'", "'", None, lines=True), string('"', '"', hole=(r"\$\(", "(", ")"), lines=True), Rule(r"\\.", STRING, end="")),
    "nix": (_HASH, _STARS, string("''", "''", r"''\$|'''|''\\.", _DOLLAR, True), string('"', '"', hole=_DOLLAR, lines=True)),
    "make": (line_comment(r"(?<!\\)#"),),
    "cmake": (chosen(r"#\[(=*)\[", lambda m: re.escape(f"]{m[1]}]"), COMMENT), _HASH, chosen(r"\[(=*)\[", lambda m: re.escape(f"]{m[1]}]")), string('"', '"', lines=True)),
    "sql": (line_comment("--"), _NESTED, chosen(r"\$([A-Za-z_]*)\$", lambda m: re.escape(m[0])), string(r"(?<=[eE])'", "'", r"\\.|''", lines=True), string("'", "'", "''", lines=True)),
    "erlang": (Rule(r"\$\\?.", STRING, end=""), line_comment("%"), string('"', '"', lines=True), _SINGLE),
    "r": (_HASH, chosen(r"(?<!\w)[rR](['\"])(-*)([(\[{])", lambda m: re.escape(_PAIRS[m[3]] + m[2] + m[1])), string('"', '"', lines=True), string("'", "'", lines=True), string("`", "`")),
    "just": (*_TRIPLES, _HASH, _DOUBLE, string("'", "'", None), string("`", "`", None)),
    "starlark": (*_TRIPLES, _HASH, chosen(r"(?<!\w)r(['\"])", lambda m: m[1], STRING), _DOUBLE, _SINGLE),
}


@lru_cache(maxsize=None)
def _begins(language: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(r.begin) for r in TABLE[language])


class _Next:
    """The first rule that may begin at a place or behind it; each rule's next place is kept until it is passed."""

    def __init__(self, text: str, language: str):
        self.text, self.rules, self.begins = text, TABLE[language], _begins(language)
        self.found: list[re.Match | None] = [p.search(text) for p in self.begins]

    def __call__(self, i: int) -> tuple[Rule, re.Match] | None:
        best = None
        for k, m in enumerate(self.found):
            if m is not None and m.start() < i:
                m = self.found[k] = self.begins[k].search(self.text, i)
            if m is not None and (best is None or m.start() < best[1].start()):
                best = self.rules[k], m
        return best


@lru_cache(maxsize=None)
def _bracket(opens: str, closes: str) -> re.Pattern:
    return re.compile(f"[{re.escape(opens)}{re.escape(closes)}]")


def _stop(rule: Rule, in_string: bool) -> re.Pattern:
    if not in_string:
        return re.compile(rf"{rule.begin}|{rule.nests}")
    parts = [f"(?P<escape>{rule.escape})" if rule.escape else None, f"(?P<hole>{rule.hole[0]})" if rule.hole else None, f"(?P<quote>{re.escape(rule.quote)})", None if rule.lines else r"(?P<line>\n)"]
    return re.compile("|".join(p for p in parts if p), re.S)


_stops = lru_cache(maxsize=None)(_stop)


def spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the outermost comments and literals, in order. One that nothing closes ends with the text, or with its line."""
    following = _Next(text, language)
    out: list[tuple[int, int, str]] = []
    n, i = len(text), 0
    if language == "php":  # what comes before the first tag is no code
        first = re.compile(r"<\?(?:php\b|=)?").search(text)
        i = first.end() if first else n
        if i:
            out.append((0, i, TEXT))
    #: open strings, each with the place where its outermost one began; open holes, each with its depth of brackets
    stack: list[list] = []
    started = 0

    def closed(at: int, kind: str) -> None:
        if not stack:
            out.append((started, at, kind))

    while i < n:
        if stack and stack[-1][0] == "string":
            rule = stack[-1][1]
            m = _stops(rule, True).search(text, i)
            if m is None:
                break
            if m.lastgroup == "escape":
                i = max(m.end(), i + 1)
            elif m.lastgroup == "hole":
                stack.append(["hole", rule.hole, 1])
                i = m.end()
            else:  # the quote, or the end of its line
                stack.pop()
                i = m.end() if m.lastgroup == "quote" else m.start()
                closed(i, rule.kind)
            continue
        begun = following(i)
        if stack:  # in a hole: its own brackets count, and the next literal or bracket comes first
            _, opens, closes = stack[-1][1]
            bracket = _bracket(opens, closes).search(text, i)
            if bracket is None:
                break
            if begun is None or bracket.start() < begun[1].start():
                stack[-1][2] += 1 if bracket[0] == opens else -1
                if not stack[-1][2]:
                    stack.pop()
                i = bracket.end()
                continue
        if begun is None:
            break
        rule, b = begun
        at = b.start()
        if not stack:
            started = at
        if rule.quote is not None:
            stack.append(["string", rule])
            i = b.end()
            continue
        i = _past(text, rule, b)
        closed(i, rule.kind)
    if stack:
        out.append((started, n, TEXT))
    return out


def _past(text: str, rule: Rule, begin: re.Match) -> int:
    """Behind a comment or a quotation without holes."""
    at = begin.end()
    if rule.nests is not None:
        depth = 1
        for m in _stops(rule, False).finditer(text, at):
            depth += 1 if re.match(rule.begin, m[0]) else -1
            if not depth:
                return m.end()
        return len(text)
    if rule.end == "":
        return max(at, begin.start() + 1)
    m = re.compile(rule.end if rule.closing is None else rule.closing(begin)).search(text, at)
    return m.end() if m else len(text)


def blank(text: str, language: str, strings: bool = True) -> str:
    """The text with comments, and strings if so asked, as spaces; length and line ends stay. Text over lines is always blanked."""
    out, at = [], 0
    for start, end, kind in spans(text, language):
        if strings or kind != STRING:
            out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
            at = end
    return "".join(out) + text[at:]
