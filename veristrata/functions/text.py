"""Scalar functions on text, as Column expressions; offsets and lengths are those of UTF-8 bytes where said."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = "A-Za-z0-9_"
#: ASCII word boundaries; Java's \\b would also see letters beyond ASCII.
LEFT, RIGHT = f"(?<![{WORD}])", f"(?![{WORD}])"
BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def byte_view(text: Column) -> Column:
    """One character per UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_byte_view(text: Column) -> Column:
    return F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """An anchored regular expression for a glob with * ? and [..]; crosses: whether * matches slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 2] == "**":
                i += 1
                out.append(".*")
                if pattern[i + 1 : i + 2] == "/" and not crosses:
                    i += 1
            else:
                out.append(".*" if crosses else "[^/]*")
        elif c == "?":
            out.append("." if crosses else "[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def segment_glob_regex(pattern: str) -> str:
    """A glob over path segments: ** stands for any number of whole segments, * and ? stay within one."""
    out = ""
    parts = pattern.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:.*)" if last else "(?:[^/]+/)*"
        else:
            out += glob_regex(part, crosses=False)[5:-1] + ("" if last else "/")
    return "^" + out + "$"


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """ASCII-case-insensitive substring."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(text, upper, lower), F.lit("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in needle)))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset."""
    before = F.substring(byte_view(text), F.lit(1), offset)
    return F.lit(1) + F.length(before) - F.length(F.replace(before, F.lit("\n")))


def module_qualifier(path: Column) -> Column:
    """A path as a dotted prefix: its last extension goes, slashes become dots."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), 0)


def same_magnitude(a: Column, b: Column) -> Column:
    """Both positive and within one order of magnitude."""
    return (a > 0) & (b > 0) & (F.abs(F.floor(F.log10(a)) - F.floor(F.log10(b))) <= 1)


def is_year(v: Column) -> Column:
    return (v >= 1900) & (v <= 2100) & (v == F.floor(v))


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, text, value>> of all matches of a pattern in the byte view of column `text`.

    Offsets are sums over what lies between and in the matches, so no row leaves the JVM.
    """
    return _matches(text, _literal(pattern), group)


def matches_of(text: str, pattern: str) -> Column:
    """matches() of the pattern that a column holds."""
    return _matches(text, pattern, 0)


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int) -> Column:
    return F.expr(_matches_sql(f"decode(encode({text}, 'UTF-8'), 'ISO-8859-1')", pattern, group))


def _matches_sql(view: str, pattern: str, group: int) -> str:
    whole, value = f"regexp_extract_all({view}, {pattern}, 0)", f"regexp_extract_all({view}, {pattern}, {group})"
    start = "b.at + length(x.`2`)"
    return _running(
        f"arrays_zip({whole}, {value}, slice(split({view}, {pattern}), 1, size({whole})))",
        "struct<start:int,end:int,text:string,value:string>",
        f"named_struct('start', {start}, 'end', {start} + length(x.`0`), 'text', x.`0`, 'value', x.`1`)",
        f"{start} + length(x.`0`)",
    )


def _running(items: str, kind: str, item: str, after: str) -> str:
    """SQL for array<kind>: an item for each x of items, at the running offset b.at, which `after` moves on.

    Arrays grow by 64 items at a time, so long texts do not copy what they have for every item.
    """
    inner = f"aggregate(slice(z, c * 64 + 1, 64), named_struct('at', a.at, 'out', cast(array() AS array<{kind}>)), (b, x) -> named_struct('at', {after}, 'out', concat(b.out, array({item}))))"
    outer = f"(a, c) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out))))[0]"
    return f"transform(array({items}), z -> aggregate(sequence(0, greatest(size(z) - 1, 0) div 64), named_struct('at', 0, 'out', cast(array() AS array<array<{kind}>>)), {outer}, a -> flatten(a.out)))[0]"


def sentences(text: str) -> Column:
    """Sentences with their byte spans: pieces between . ! ? and line ends, empty ones dropped."""
    found = _running(
        f"split(decode(encode({text}, 'UTF-8'), 'ISO-8859-1'), '[.!?\\n]')",
        "struct<start:int,end:int,text:string>",
        "named_struct('start', b.at, 'end', b.at + length(x), 'text', decode(encode(x, 'ISO-8859-1'), 'UTF-8'))",
        "b.at + length(x) + 1",
    )
    return F.expr(f"filter({found}, s -> trim(s.text) <> '')")


def words_among(text: Column, words: list[str]) -> Column:
    """array<string>: the distinct words of a text that are in a list, which becomes one literal; "" stands for any text."""
    if not words:
        return F.array().cast("array<string>")
    listed = F.array_append(F.array_distinct(F.regexp_extract_all(text, F.lit(f"([{WORD}]+)"), 1)), F.lit(""))
    return F.array_intersect(listed, F.split(F.lit("\n".join(sorted(set(words)))), "\n"))


@F.pandas_udf(StringType())
def normalize_path(path):
    """Forward slashes and NFC."""
    return path.map(lambda p: unicodedata.normalize("NFC", p.replace("\\", "/")) if p is not None else None)


# ---------------------------------------------------------------- shaping of messages


def one_line(text: Column, size: int) -> Column:
    """The first line, cut to `size` characters with an ellipsis."""
    first = F.trim(F.split(text, "\n")[0])
    return F.when(F.length(first) > size, F.concat(F.substring(first, 1, size - 1), F.lit("…"))).otherwise(first)


def cut_bytes(text: Column, size: int, trailer: str = "") -> Column:
    """At most `size` bytes; what is cut off is marked by the trailer, which counts."""
    keep = max(0, size - len(trailer.encode()))
    view = byte_view(text)
    # the cut goes back to where a character begins
    at = F.array_max(F.filter(F.sequence(F.lit(max(0, keep - 3)), F.lit(keep)), lambda i: ~F.substring(view, i + 1, F.lit(1)).rlike("[\\x80-\\xbf]")))
    return F.when(F.octet_length(text) > size, F.concat(from_byte_view(F.substring(view, F.lit(1), at)), F.lit(trailer))).otherwise(text)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def human_duration(seconds: Column) -> Column:
    """45s, 12m, 3h or 2d."""
    s = seconds.cast("long")
    unit = lambda size, name: F.concat(F.floor(s / size).cast("string"), F.lit(name))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def since_seconds(day: Column) -> Column:
    """Unix seconds of a day YYYY-MM-DD, in UTC; null for anything else."""
    ok = day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.when(ok, F.datediff(F.try_to_date(day, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long") * 86400)


def fingerprint(command: Column) -> Column:
    """sha256 of a command without the white space around it."""
    return F.sha2(F.regexp_replace(command, r"^\s+|\s+$", ""), 256)


def verify_verb(command: Column) -> Column:
    """The program, with its first argument unless that is a flag; `verify` for an empty command."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    second = F.try_element_at(words, F.lit(2))
    return F.when(F.size(words) == 0, "verify").when(second.isNull() | F.startswith(second, F.lit("-")), words[0]).otherwise(F.concat(words[0], F.lit(" "), second))


def without_noise(output: Column, packages: tuple[str, ...]) -> Column:
    """A verifier's output without the blocks of these packages; a block is a `# package` line and what follows it."""

    def is_noise(line):
        hit = F.lit(False)
        for p in packages:
            hit = hit | (line == f"# {p}") | F.startswith(line, F.lit(f"# {p} "))
        return hit

    def step(a, line):
        skip = F.when(F.startswith(line, F.lit("# ")), is_noise(line)).otherwise(a["skip"])
        return F.struct(skip.alias("skip"), F.when(skip, a["out"]).otherwise(F.array_append(a["out"], line)).alias("out"))

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(F.split(output, "\n"), start, step, lambda a: F.array_join(a["out"], "\n"))
    return F.regexp_replace(kept, r"^\s+|\s+$", "")


def first_error(output: Column, exit_error: Column, size: int = 200) -> Column:
    """The first line that is neither blank nor a header, else the exit error; at most `size` bytes."""
    lines = F.filter(F.transform(F.split(output, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("# ")))
    return cut_bytes(F.coalesce(F.try_element_at(lines, F.lit(1)), exit_error, F.lit("")), size)


def contained(path: Column, root: str) -> Column:
    """Where a path, absolute or relative to root, lies under root after . and .. are resolved: that absolute path, else null.

    Paths are compared as text; NUL, CR and LF are refused, and so is an empty path. Links on disk are not followed.
    """
    base = "/" + "/".join(p for p in root.split("/") if p)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path))
    kept = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"))
    inside = (clean == base) | F.startswith(clean, F.lit(base if base == "/" else base + "/"))
    return F.when((path != "") & ~path.rlike(r"[\x00\r\n]") & inside, clean)


def matches_target(path: Column, patterns: list[str]) -> Column:
    """A glob of the list fits the base name or the whole path; an empty list fits all."""
    if not patterns:
        return F.lit(True)
    name, out = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in patterns:
        r = glob_regex(p, crosses=False)
        out = out | name.rlike(r) | path.rlike(r)
    return out


def scope_regex(pattern: str) -> str:
    """A scope's glob as an anchored expression: ** crosses folders and takes a slash after it along, * and ? stay within one."""
    return glob_regex(pattern, crosses=False)
