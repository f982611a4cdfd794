"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest that fits a URL decides it. URLs joined by redirects (meta
refresh in a page, or a table of crawl redirects) and canonical links are one document under several names:
connected components over those edges carry a block decision from any member to those that no rule decides. A
rule that allows a URL explicitly holds against that, and a URL that nothing decides is allowed.

All canonical links and refreshes of a page count. Their targets are resolved against the page's URL as RFC 3986
says (scheme, network, root, query and path references, dot segments), after character references are decoded and comments
and scripts left out, in one pass over the page. Nodes of the graph are normalised: scheme and host in lower case, no default port, no fragment, an
empty path is the root. A target that names no host joins nothing.

Rules are joined by host suffixes, so their number may be anything; pages are judged once for each distinct URL.

Defined results: null and scheme-less URLs have empty host and path, fit no rule and are allowed, and their links
join nothing; null html has no links; html of any length is read whole; of rules of one length the block goes before the
allow by the order of the rules' text; repeated rows are judged alike; an empty table gives an empty table; extra columns are
not touched, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .components import components

#: The contract's rules: host, path, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: What follows down to _TO is how SQL takes a page apart; a page that leaves nothing open gives the same links either way.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
CANONICAL = r"""(?i)<link\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*>"""
_IS_CANONICAL = r"""(?i)\srel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_IS_REFRESH = r"""(?i)\shttp-equiv\s*=\s*(?:"\s*refresh\s*"|'\s*refresh\s*'|refresh[\s/>])"""
_HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
_CONTENT = r"""(?i)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
_TO = r"""(?i)^[^;,]*[;,]\s*url\s*=\s*["']?([^"'\s]+)"""
#: Character references that URLs hold, the ampersand's last.
_REFERENCES = (("&(?:quot|#34|#[xX]22);", '"'), ("&(?:apos|#39|#[xX]27);", "'"), ("&(?:lt|#60|#[xX]3[cC]);", "<"), ("&(?:gt|#62|#[xX]3[eE]);", ">"), ("&(?:sol|#47|#[xX]2[fF]);", "/"), ("&(?:colon|#58|#[xX]3[aA]);", ":"), ("&(?:amp|#38|#[xX]26);", "&"))
_MARK = re.compile(r"(<!--|<(?:script|style|link|meta)\b)", re.I)
_END = {"<!--": re.compile("-->"), "<script": re.compile(r"</script\s*>", re.I), "<style": re.compile(r"</style\s*>", re.I)}
#: The end of a tag, or a name and what its value begins with; no part is ever tried again.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>]*+)))?)""")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"  # scheme, host, path, query
_URL, _TARGET = re.compile(_PARTS), re.compile(_TO)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, action): a table of literals, made without Python rows."""
    each = F.array(*(F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(a).alias("action")) for h, p, a in rules))
    return spark.range(1, numPartitions=1).select(F.inline(each))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, action): the longest rule that fits each distinct url, else nulls."""
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = parts.filter("host <> ''").withColumn("suffix", F.explode(suffixes))
    met = each.join(rules, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.char_length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best")
    best = met.groupBy(F.col("url").alias("_url")).agg(best)
    return parts.join(best, F.col("url").eqNullSafe(F.col("_url")), "left").select("url", "host", "path", "best.rule", "best.action")


def node(url: Column) -> Column:
    """A URL's name in the graph; null if it has no scheme and host."""
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    scheme, host_ = F.translate(part(1), _UPPER, _LOWER), F.translate(part(2), _UPPER, _LOWER)
    port = F.when(scheme == "http", F.regexp_replace(host_, ":(?:80)?$", "")).when(scheme == "https", F.regexp_replace(host_, ":(?:443)?$", "")).otherwise(host_)
    return F.when(part(2) != "", F.concat(scheme, F.lit("://"), port, F.when(part(3) == "", F.lit("/")).otherwise(part(3)), part(4)))


def targets(html: str) -> list[str]:
    """References of a page's canonical links and meta refreshes, comments, scripts and styles left out.

    One pass from left to right: every search goes on where the last one ended, and one that finds no end is not made again, so the time is
    linear in the page, whatever is left open in it.
    """
    found, at, open_ended = [], 0, set()
    while mark := _MARK.search(html, at):
        name, at = mark[1].lower(), mark.end()
        if name in _END:
            end = None if name in open_ended else _END[name].search(html, at)
            if end:
                at = end.end()
            else:  # nor will a later one end
                open_ended.add(name)
            continue
        values: dict[str, str] = {}
        while part := _ATTRIBUTE.match(html, at):
            at = part.end()
            if part[1]:
                break
            value = part[4] or ""
            if part[3]:
                close = html.find(part[3], at)
                if close < 0:  # the rest of the page is this value
                    return found
                value, at = html[at:close], close + 1
            values.setdefault(part[2].lower(), value)
        else:
            return found
        if name == "<link" and "canonical" in values.get("rel", "").lower().split():
            found.append(_decoded(values.get("href", "").strip(" ")))
        if name == "<meta" and values.get("http-equiv", "").strip().lower() == "refresh":
            to = _TARGET.match(_decoded(values.get("content", "").strip(" ")))
            found.append(to[1] if to else "")
    return [x for x in found if x]


def _decoded(text: str) -> str:
    for pattern, char in _REFERENCES:
        text = re.sub(pattern, char, text)
    return text


def _without_dots(path_: str) -> str:
    """A path from the root with its dot segments taken out."""
    kept: list[str] = []
    names = path_.split("/")[1:]
    for name in names:
        if name == "..":
            del kept[-1:]
        elif name != ".":
            kept.append(name)
    return "/" + "/".join(kept) + ("/" if kept and names[-1] in (".", "..") else "")


def resolved(base: str, reference: str) -> str | None:
    """The URL that a reference in the page at ``base`` names; none if either names no host."""
    own = _URL.match(base)
    if not own:
        return None
    origin, path_, query = f"{own[1]}://{own[2]}", own[3], own[4] or ""
    absolute = _SCHEME.match(reference)
    if absolute or reference.startswith("//"):
        full = _URL.match(reference if absolute else f"{own[1]}:{reference}")
        return full and f"{full[1]}://{full[2]}" + (_without_dots(full[3]) if full[3] else "") + (full[4] or "")
    ref_path, _, rest = reference.split("#")[0].partition("?")
    rest = "?" + rest if "?" in reference.split("#")[0] else ""
    if not ref_path:
        return origin + path_ + (rest or query)
    return origin + _without_dots(ref_path if ref_path.startswith("/") else (path_ or "/").rpartition("/")[0] + "/" + ref_path) + rest


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): URL of a page and target of each of its canonical links and meta refreshes."""

    def run(batches):
        for batch in batches:
            edges = [(url, to) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for ref in targets(html) if (to := resolved(url, ref))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*edges, strict=True) if edges else ([], []))], ["a", "b"])

    some = F.col("html").rlike(r"(?i)canonical|refresh")  # most pages have neither: they do not leave the engine
    return pages.filter(F.col("url").isNotNull() & some).select("url", "html").mapInArrow(run, "a string, b string")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict). ``redirects`` has columns a, b: further equivalent URLs."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    edges = materialise(edges.distinct(), "links")
    # targets need not be pages: a rule on them counts as well
    urls = pages.select("url").union(edges.select("a")).union(edges.select("b")).distinct()
    known = materialise(ruled(urls, rules).withColumn("node", node(F.col("url"))), "ruled")
    alias = materialise(components(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b"))), "aliases")
    alias = alias.select(F.col("node").alias("_node"), "root")
    blocked = known.filter("action = 'block' and node is not null").select("node").distinct()
    blocked = blocked.join(alias, F.col("node") == F.col("_node"), "left").select(F.coalesce("root", "node").alias("_root")).distinct()
    blocked = materialise(blocked, "blocked-roots")  # a written table, so that Spark splits the join where a component is large
    rooted = known.join(alias, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))
    decided = rooted.join(blocked, F.col("root") == F.col("_root"), "left")
    verdict = F.coalesce("action", F.when(F.col("_root").isNotNull(), "block").otherwise("allow"))
    decided = decided.select(F.col("url").alias("_url"), "host", "path", "rule", verdict.alias("verdict"))
    decided = materialise(decided, "decided")
    return pages.select("page_id", "url").join(decided, F.col("url").eqNullSafe(F.col("_url")), "left").drop("_url")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_table(spark)).drop("url")


def _sql() -> str:
    """The same in SQL, each step spelt with the same patterns."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    get = lambda x, p, k=0: f"regexp_extract({x}, {lit(p)}, {k})"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    value = lambda x, p: f"trim({get(x, p, 1)} || {get(x, p, 2)} || {get(x, p, 3)})"
    tags = lambda p, is_: f"list_filter(regexp_extract_all(h, {lit(p)}), lambda x: regexp_matches(x, {lit(is_)}))"

    def decoded(x: str) -> str:
        for pattern, char in _REFERENCES:
            x = f"regexp_replace({x}, {lit(pattern)}, {lit(char)}, 'g')"
        return x

    def node_(u: str) -> str:
        scheme, host_ = lower(get(u, _PARTS, 1)), lower(get(u, _PARTS, 2))
        port = f"CASE {scheme} WHEN 'http' THEN regexp_replace({host_}, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace({host_}, ':(?:443)?$', '') ELSE {host_} END"
        return f"CASE WHEN {get(u, _PARTS, 2)} <> '' THEN {scheme} || '://' || {port} || (CASE WHEN {get(u, _PARTS, 3)} = '' THEN '/' ELSE {get(u, _PARTS, 3)} END) || coalesce({get(u, _PARTS, 4)}, '') END"

    def dots(p: str) -> str:
        names = f"list_slice(string_split({p}, '/'), 2, len(string_split({p}, '/')))"
        walk = f"list_reduce(list_concat([''], {names}), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END)"
        return f"(CASE WHEN {walk} = '' THEN '/' ELSE {walk} END || CASE WHEN list_extract({names}, -1) IN ('.', '..') AND {walk} <> '' THEN '/' ELSE '' END)"

    origin, path_, query = get("a", r"^[^:/?#]+://[^/?#]*"), get("a", _PARTS, 3), f"coalesce({get('a', _PARTS, 4)}, '')"
    ref_path, rest = get("r", r"^([^?#]*)(\?[^#]*)?", 1), f"coalesce({get('r', r'^([^?#]*)(\?[^#]*)?', 2)}, '')"
    absolute = "regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:')"
    full = get("t", _PARTS)
    return rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(map(str, RULES))}) r(rule_host, rule_path, action)),
l0 AS (SELECT url AS a, regexp_replace(coalesce(html, ''), {lit(_HIDDEN)}, '', 'g') AS h FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
l1 AS (SELECT a, unnest(list_concat(list_transform({tags(CANONICAL, _IS_CANONICAL)}, lambda x: {decoded(value("x", _HREF))}), list_transform({tags(REFRESH, _IS_REFRESH)}, lambda x: {get(decoded(value("x", _CONTENT)), _TO, 1)}))) AS r FROM l0),
l2 AS (SELECT a, r, {origin} AS origin, {path_} AS path, {query} AS query, {ref_path} AS rp, {rest} AS rest FROM l1 WHERE r <> ''),
l3 AS (SELECT *, regexp_extract(CASE WHEN path = '' THEN '/' ELSE path END, '^.*/') || rp AS merged FROM l2),
l4 AS (SELECT a, r, origin, CASE WHEN {absolute} THEN r WHEN starts_with(r, '//') THEN {get("a", _PARTS, 1)} || ':' || r WHEN rp = '' THEN origin || path || CASE WHEN rest = '' THEN query ELSE rest END
  WHEN starts_with(r, '/') THEN origin || {dots("rp")} || rest ELSE origin || {dots("merged")} || rest END AS t FROM l3),
l5 AS (SELECT a, r, t, {full} AS f, {get("t", _PARTS, 3)} AS fp, coalesce({get("t", _PARTS, 4)}, '') AS fq FROM l4 WHERE origin <> '' AND {full} <> ''),
e0 AS (SELECT a, CASE WHEN ({absolute} OR starts_with(r, '//')) AND fp <> '' THEN {get("f", r"^[^:/?#]+://[^/?#]*")} || {dots("fp")} || fq WHEN {absolute} OR starts_with(r, '//') THEN f ELSE t END AS b FROM l5),
n AS (SELECT {node_("a")} AS a, {node_("b")} AS b FROM e0),
e AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
u AS (SELECT url FROM pages UNION SELECT b FROM e0),
p AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT url, {node_("url")} AS node, {lower("regexp_extract(coalesce(rest,''), '^[^/?#]*')")} AS host, regexp_extract(coalesce(rest,''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT h.*, (SELECT max({{'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'action': action}}) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM h),
bad AS (SELECT DISTINCT node FROM k WHERE k.best.action = 'block'),
t AS (SELECT node FROM bad UNION SELECT r.a FROM reach r JOIN bad ON bad.node = r.b)
SELECT page_id, host, path, k.best.rule AS rule, coalesce(k.best.action, CASE WHEN t.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN k ON pages.url IS NOT DISTINCT FROM k.url LEFT JOIN t ON t.node = k.node"""


SQL = {"op8_url_filter": _sql()}
