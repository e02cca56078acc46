"""A reader for the YAML of truth and configuration files, as no parser is installed.

Block and flow maps and lists, plain and quoted scalars, literal and folded blocks, comments, anchors and aliases, merge
keys, and the tags of scalars. Of several documents the first is read. Complex keys are errors that name their line.
"""

from __future__ import annotations

import re

_KEY = re.compile(r'''("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^\s\[\]{},#&*!|>@%`"\'-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)''')
#: An anchor or a tag before a node.
_PROPERTY = re.compile(r"(?:&([^\s,\[\]{}]+)|(!<[^>]*>|![^\s,\[\]{}]*))(?:[ \t]+|$|(?=[,\]}]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "e": "\x1b", "/": "/", "\\": "\\", '"': '"', " ": " ", "N": "\x85", "_": "\xa0"}


def load(text: str):
    """The tree of maps, lists and scalars; None for an empty text. Dates stay text."""
    return _Reader(text).document()


def scalar(s: str):
    """The value of a plain scalar."""
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return s.lower() == "true"
    plain = s.replace("_", "")
    if re.fullmatch(r"[-+]?(0|[1-9][0-9]*)", plain):
        return int(plain)
    if re.fullmatch(r"[-+]?0x[0-9a-fA-F]+|[-+]?0o?[0-7]+|[-+]?0b[01]+", plain):
        return int(re.sub(r"^([-+]?)0([0-7])", r"\g<1>0o\2", plain), 0)
    if re.fullmatch(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?", plain):
        return float(plain)
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", s):
        return float(s.replace(".", "").lower())
    return float("nan") if s in (".nan", ".NaN", ".NAN") else s


def _tagged(tag: str, value):
    """A value as its tag has it: the core tags of scalars convert its text; a tag of one's own leaves text as it is."""
    kind = tag.removeprefix("!<tag:yaml.org,2002:").removesuffix(">").removeprefix("!!")
    if not isinstance(value, str) or kind in ("map", "seq"):
        return value
    if kind in ("str", "binary", "timestamp") or tag.startswith("!") and not tag.startswith(("!!", "!<")):
        return value
    found = scalar(value)
    if kind == "float" and type(found) is int:
        return float(found)
    wanted = {"int": int, "float": float, "bool": bool, "null": type(None)}.get(kind)
    if wanted and type(found) is not wanted:
        raise ValueError(f"{value!r} is no {kind}")
    return found


class _Reader:
    def __init__(self, text: str):
        self.lines = text.lstrip("\ufeff").splitlines()
        self.at = 0
        self.anchors: dict[str, object] = {}

    def properties(self, body: str) -> tuple[str | None, str | None, str]:
        """The anchor and the tag that body begins with, and what follows them."""
        anchor = tag = None
        while m := _PROPERTY.match(body):
            anchor, tag, body = m[1] or anchor, m[2] or tag, body[m.end() :]
        return anchor, tag, body

    def kept(self, anchor: str | None, value):
        if anchor:
            self.anchors[anchor] = value
        return value

    def alias(self, name: str):
        if name not in self.anchors:
            self.fail(f"nothing is called {name!r}")
        return self.anchors[name]

    def merged(self, out: dict, more) -> None:
        """The entries of one map, or of several, that out does not have."""
        for each in more if isinstance(more, list) else [more]:
            if not isinstance(each, dict):
                self.fail("only maps can be merged")
            for k, v in each.items():
                out.setdefault(k, v)

    def fail(self, what: str):
        raise ValueError(f"line {self.at + 1}: {what}")

    def peek(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has any, without a comment at its end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body.startswith("\t") and body.strip():
                self.fail("a tab cannot indent")
            if not body.strip() or body.startswith("#"):
                self.at += 1
                continue
            return len(line) - len(body), _uncommented(body)
        return None

    def document(self):
        first = self.peek()
        while first and (first[1] == "---" or first[1].startswith("%")):
            self.at += 1
            first = self.peek()
        if first and first[1].startswith("--- "):
            self.lines[self.at] = self.lines[self.at][4:].lstrip(" ")
        value = self.node(0) if first else None
        rest = self.peek()
        if rest and rest[1] not in ("...", "---") and not rest[1].startswith("--- "):
            self.fail(f"cannot read {rest[1]!r} here")
        return value

    def node(self, least: int):
        """The node that begins on the next line, indented by at least `least`; None if there is none."""
        found = self.peek()
        if not found or found[0] < least or found[1] in ("---", "..."):
            return None
        indent, body = found
        anchor, tag, rest = self.properties(body)
        if rest != body:
            if not rest:
                self.at += 1
                return self.kept(anchor, self.node(least))
            if not _KEY.match(rest):
                self.at += 1
                return self.kept(anchor, self.value(rest, indent, tag))
            self.lines[self.at] = " " * indent + rest
            self.kept(anchor, _KEY.match(rest)[1])  # before a key they are the key's
            return self.node(least)
        if body == "-" or body.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(body):
            return self.mapping(indent)
        self.at += 1
        return self.value(body, indent)

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            anchor, tag, rest = self.properties(found[1][1:].lstrip(" "))
            if not rest:
                self.at += 1
                value = self.node(indent + 1)
            elif rest[0] in "|>" or not (rest == "-" or rest.startswith("- ") or _KEY.match(rest)):
                self.at += 1
                value = self.value(rest, indent, tag)
            else:  # a node that begins on the dash's own line
                line = self.lines[self.at]
                tail = self.properties(line[indent + 1 :].lstrip(" "))[2]
                self.lines[self.at] = " " * (len(line) - len(tail)) + tail
                value = self.node(indent + 1)
            out.append(self.kept(anchor, value))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        merges: list = []
        while (found := self.peek()) and found[0] == indent and (m := _KEY.match(found[1])):
            key = _unquoted(m[1]) if m[1][0] in "\"'" else m[1]
            if key in out:
                self.fail(f"the key {key!r} is there twice")
            anchor, tag, rest = self.properties(found[1][m.end() :].strip())
            self.at += 1
            below = self.peek()
            if rest:
                value = self.value(rest, indent, tag)
            elif below and below[0] == indent and (below[1] == "-" or below[1].startswith("- ")):
                value = self.sequence(indent)
            else:
                value = self.node(indent + 1)
                value = "" if value is None and tag == "!!str" else value
            self.kept(anchor, value)
            if key == "<<":
                merges.append(value)
            else:
                out[key] = value
        if found and found[0] > indent:
            self.fail("the indentation fits nothing")
        for more in merges:
            self.merged(out, more)
        return out

    def value(self, body: str, indent: int, tag: str | None = None):
        """A value whose text begins with body; the lines after it that belong to it are further in than indent."""
        if body[0] == "*":
            return self.alias(body[1:].strip())
        if body[0] in "|>":
            return self.typed(tag, self.block(body, indent))
        if body[0] in "[{\"'":
            while not _closed(body):
                if self.at >= len(self.lines):
                    self.fail("a quotation or bracket is not closed")
                body += " " + _uncommented(self.lines[self.at].strip()) if body[0] in "[{" else " " + self.lines[self.at].strip()
                self.at += 1
            return self.typed(tag, _Flow(body, self).whole())
        while (more := self.peek()) and more[0] > indent and not _KEY.match(more[1]):
            body += " " + more[1]
            self.at += 1
        return self.typed(tag, body) if tag else scalar(body)

    def typed(self, tag: str | None, value):
        try:
            return _tagged(tag, value) if tag else value
        except ValueError as e:
            self.fail(str(e))

    def block(self, head: str, indent: int) -> str:
        m = re.fullmatch(r"([|>])([-+]?)([1-9]?)([-+]?)", head)
        if not m:
            self.fail(f"cannot read {head!r}")
        chomp, depth, rows = m[2] or m[4], indent + int(m[3]) if m[3] else None, []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            size = len(line) - len(line.lstrip(" "))
            if line.strip():
                depth = size if depth is None and size > indent else depth
                if depth is None or size < depth:
                    break
            rows.append(line[depth or 0 :] if line.strip() else "")
            self.at += 1
        ends = len(rows)
        while ends and not rows[ends - 1]:
            ends -= 1
        kept, blank = rows[:ends], len(rows) - ends
        text = "\n".join(kept) if m[1] == "|" else _folded(kept)
        if not kept:
            return "\n" * blank if chomp == "+" else ""
        return text if chomp == "-" else text + "\n" * (1 + blank if chomp == "+" else 1)


def _folded(rows: list[str]) -> str:
    """Lines joined by spaces; blank lines are line ends, and lines that are further in keep theirs."""
    out, gap = "", 0
    before = ""
    for row in rows:
        if not row:
            gap += 1
            continue
        if out:
            out += "\n" * (gap + 1 if row[0] == " " or before[:1] == " " else gap) or " "
        out, before, gap = out + row, row, 0
    return out


def _uncommented(body: str) -> str:
    quote = ""
    for i, c in enumerate(body):
        if quote:
            if c == quote and (quote == "'" or not re.search(r"(?<!\\)(\\\\)*\\$", body[:i])):
                quote = ""
        elif c in "\"'" and (i == 0 or body[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and body[i - 1] in " \t":
            return body[:i].rstrip()
    return body.rstrip()


def _closed(body: str) -> bool:
    depth, quote, i = 0, "", 0
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\" and quote == '"':
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'" and (i == 0 or body[i - 1] in " [{,:"):
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        i += 1
    return not quote and depth <= 0


def _unquoted(s: str) -> str:
    if s[0] == "'":
        return s[1:-1].replace("''", "'")

    def escape(m):
        c = m[1]
        if c[0] in "xuU":
            return chr(int(c[1:], 16))
        if c[0] not in _ESCAPES:
            raise ValueError(f"no escape \\{c}")
        return _ESCAPES[c[0]]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", escape, s[1:-1])


class _Flow:
    """[..], {..} and quoted scalars of one joined line."""

    def __init__(self, text: str, reader: _Reader):
        self.text, self.i, self.reader = text, 0, reader

    def whole(self):
        value = self.value()
        if self.text[self.i :].strip():
            self.reader.fail(f"cannot read {self.text[self.i :].strip()!r} here")
        return value

    def space(self) -> str:
        while self.i < len(self.text) and self.text[self.i] in " \t":
            self.i += 1
        return self.text[self.i] if self.i < len(self.text) else ""

    def value(self, stops: str = ",]}", tag: str | None = None):
        c = self.space()
        if c == "[":
            self.i += 1
            out: list = []
            while (c := self.space()) != "]":
                if not c:
                    self.reader.fail("a bracket is not closed")
                out.append(self.value())
                if self.space() == ",":
                    self.i += 1
            self.i += 1
            return out
        if c == "{":
            self.i += 1
            pairs: dict = {}
            merges: list = []
            while (c := self.space()) != "}":
                if not c:
                    self.reader.fail("a brace is not closed")
                key = self.value(",]}:")
                if self.space() == ":":
                    self.i += 1
                    value = None if self.space() in ",}" else self.value()
                    if key == "<<":
                        merges.append(value)
                    else:
                        pairs[str(key)] = value
                else:
                    pairs[str(key)] = None
                if self.space() == ",":
                    self.i += 1
            self.i += 1
            for more in merges:
                self.reader.merged(pairs, more)
            return pairs
        if c and c in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"' if c == '"' else r"'(?:[^']|'')*'").match(self.text, self.i)
            self.i = m.end()
            return self.reader.typed(tag, _unquoted(m[0]))
        if c == "*":
            m = re.compile(r"\*([^\s,\[\]{}]+)").match(self.text, self.i)
            if not m:
                self.reader.fail("an alias needs a name")
            self.i = m.end()
            return self.reader.alias(m[1])
        if m := _PROPERTY.match(self.text, self.i):
            self.i = m.end()
            value = self.value(stops, m[2] or tag)
            return self.reader.kept(m[1], value)
        start = self.i
        while self.i < len(self.text):
            c = self.text[self.i]
            if c in ",]}" or c == ":" and ":" in stops and self.text[self.i + 1 : self.i + 2] in (" ", "", ",", "}"):
                break
            self.i += 1
        plain = self.text[start : self.i].strip()
        return self.reader.typed(tag, plain) if tag else scalar(plain)
