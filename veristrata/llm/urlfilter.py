"""URL filters: rules by host and path, carried to aliases over redirects and canonical links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds __host (A-Z lower-cased) and __path; both empty if the url is null or has no `://`."""
    df = df.withColumn("__url", F.col(url))
    rest = F.when(F.instr("__url", "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    df = df.withColumn("__rest", rest)
    host = F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("__host", host).withColumn("__path", path).drop("__rest", "__url")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (verdict, host, path); a literal list."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def address(url: str) -> Column:
    """The node of a url beside split_url()'s columns: host without a default port, path and query; null without a host.

    Scheme and fragment do not tell documents apart. Everything else does: only an edge makes two addresses aliases.
    """
    query = F.regexp_extract(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"), r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(F.col("__path") == "", "/").otherwise(F.col("__path"))
    return F.when(F.col("__host") != "", F.concat(F.regexp_replace("__host", r":(80|443)$", ""), path, query))


def resolve(base: str, ref: str) -> Column:
    """The address that `ref` names on a page at `base`; null for other schemes (mailto:) and where base is not absolute."""
    base, ref = F.col(base), F.col(ref)
    scheme, site = F.regexp_extract(base, r"^([^:/?#]+):", 1), F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(ref, r"^[^?#]*", 0), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    joined = F.when(own == "", path).when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_replace(path, r"[^/]*$", ""), own))
    # . and .. are taken out of the path; a last one leaves its directory's slash
    parts = F.filter(F.split(joined, "/"), lambda x: x != "")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    end = F.when(joined.rlike(r"(^|/)\.{0,2}$") & (F.size(kept) > 0), "/").otherwise("")
    dotted = joined.rlike(r"(^|/)\.{1,2}(/|$)")
    within = F.concat(site, F.when(dotted, F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(F.when(joined.rlike("^[^/]"), F.concat(F.lit("/"), joined)).otherwise(joined)), tail)
    relative = F.when(site == "", None).when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref)).otherwise(within)
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref).when(~ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative)


#: Elements whose content is text, or is not part of the page.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template")
#: What stands in a tag up to its end; quoted values may hold one. Java matches a group's repetitions by recursion, so they are bounded: 500 quoted values.
_IN_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,1000}+>"
_NO_PAGE = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})\b{_IN_TAG}.*?(?:</\1\b[^>]*>|\z)"
_ATTRIBUTE = r"([^\s\"'<>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
# The named entities that addresses hold.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _character(entity: Column) -> Column:
    """The character that an entity stands for; numbers beyond Unicode stand for themselves."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), entity)
    hexa = F.when(entity.rlike("^&#[xX]"), F.regexp_extract(entity, "([0-9a-fA-F]+);$", 1)).otherwise(F.conv(F.regexp_extract(entity, "([0-9]+);$", 1), 10, 16))
    wide = F.lpad(hexa, 8, "0")
    valid = ((wide > "00000000") & (F.upper(wide) < "0000D800")) | ((F.upper(wide) > "0000DFFF") & (F.upper(wide) <= "0010FFFF"))
    return F.coalesce(named, F.when(valid, F.decode(F.unhex(wide), "UTF-32")), entity)


def decoded(text: Column) -> Column:
    """text with its entities as characters, each once."""
    between, found = F.split(text, _ENTITY), F.regexp_extract_all(text, F.lit(_ENTITY), 0)
    return F.array_join(F.flatten(F.zip_with(between, found, lambda t, e: F.array(t, F.coalesce(_character(e), F.lit(""))))), "")


def _attribute(tag: Column, name: str) -> Column:
    """The first value that a tag gives an attribute, without quotes, decoded and without white space around it; null if it has none."""
    pairs = F.arrays_zip(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1).alias("n"), F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2).alias("v"))
    value = F.try_element_at(F.filter(pairs, lambda p: F.lower(p["n"]) == name), F.lit(1))["v"]
    bare = F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.trim(decoded(bare), F.lit(" \t\n\r\f"))


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): canonical links and meta-refresh redirects that a page's HTML names.

    Tags in comments, in scripts and in other elements whose content is no page (RAW) do not count; attributes are those
    of a tag by name, the first of a name, with entities decoded; rel is a list of words. Relative addresses are resolved
    against the page's url; null urls and null pages name nothing.
    """
    page = F.regexp_replace(html, _NO_PAGE, " ")
    tags = F.regexp_extract_all(page, F.lit(rf"(?is)<(?:link|meta)\b{_IN_TAG}"), 0)
    tag = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(F.col(url).alias("src"), F.explode(tags).alias("tag"))
    found = tag.select("src", F.lower(F.substring("tag", 2, 4)).alias("of"), *(_attribute(F.col("tag"), n).alias(n.replace("-", "_")) for n in ("rel", "href", "http-equiv", "content")))
    canonical = (F.col("of") == "link") & F.array_contains(F.split(F.lower("rel"), r"\s+"), "canonical")
    refresh = (F.col("of") == "meta") & (F.lower("http_equiv") == "refresh")
    told = F.regexp_extract("content", r"(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1)
    aim = F.when(told.rlike("^[\"']"), F.regexp_extract(told, "(?s)^[\"']([^\"']*)", 1)).otherwise(F.trim(told))
    links = found.select("src", F.when(canonical, F.col("href")).when(refresh, aim).alias("dst")).where("dst <> ''")
    return links.select("src", resolve("src", "dst").alias("dst")).where("dst IS NOT NULL")


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    edges: DataFrame | None = None,
    url: str = "url",
    key: str = "page_id",
) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages.

    A fitting rule decides (the longest; allow before block among equals). A page without a rule takes "block"
    if an alias of it is blocked by rule and none is allowed by rule: allow has explicit precedence; else
    "allow". Aliases are the addresses of one connected component over `edges` (src, dst: redirects and canonical
    links, by url), whether pages has them or only a link names them. Rows repeat in the result as in pages; null or
    malformed urls have empty host and path, no aliases, and verdict allow; with an empty table or no edges nothing
    is propagated beyond pages of one address. pages and edges are read once, into tables.
    """
    own = F.col("__rule.verdict")

    def judged(df, c):
        df = split_url(df, c)
        return df.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules)).withColumn("__node", address(c))

    def verdicts(df):
        told = lambda v: F.coalesce(F.max((own == v).cast("int")), F.lit(0))
        return df.where("__node IS NOT NULL").groupBy("__node").agg(told("block").alias("b"), told("allow").alias("a"))

    at = judged(pages.select(F.col(key).alias("__key"), F.col(url).alias("__in")), "__in")
    at = materialize(at.select("__key", "__host", "__path", "__rule", "__node"), "judged-pages")
    nodes = verdicts(at)
    links = found = None
    if edges is not None:
        links = materialize(edges.select("src", "dst").distinct(), "links")
        ends = links
        for c, end in (("src", "u"), ("dst", "v")):
            ends = split_url(ends, c).withColumn(end, address(c)).drop("__host", "__path")
        found = connected_components(ends)
        comps = found.select(F.col("node").alias("__node"), "component")
        # the rules also judge addresses that only links name
        named = verdicts(judged(links.select(F.explode(F.array("src", "dst")).alias("__in")).distinct(), "__in"))
        nodes = nodes.unionByName(named).groupBy("__node").agg(F.max("b").alias("b"), F.max("a").alias("a"))
        nodes = nodes.join(comps, "__node", "left").withColumn("component", F.coalesce("component", "__node"))
        decided = nodes.groupBy("component").agg(F.max("b").alias("b"), F.max("a").alias("a"))
        blocked = nodes.select("__node", "component").join(decided.where("b = 1 AND a = 0"), "component").select("__node")
    else:
        blocked = nodes.where("b = 1 AND a = 0").select("__node")
    blocked = materialize(blocked, "blocked")
    discard(links)
    discard(found)
    blocked = blocked.withColumn("__blocked", F.lit(True))
    verdict = F.coalesce(own, F.when(F.col("__blocked"), "block"), F.lit("allow"))
    # only pages without a rule need their node's decision
    ruled = at.where("__rule IS NOT NULL").withColumn("__blocked", F.lit(None).cast("boolean"))
    free = at.where("__rule IS NULL").join(blocked, "__node", "left")
    return ruled.unionByName(free).select(
        F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict")
    )
