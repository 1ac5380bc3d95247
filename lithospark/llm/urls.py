"""URL filters: rules by host and path, and blocks that follow redirects.

Redirect equivalence: a page's `<link rel="canonical">` and `<meta http-equiv="refresh">` are edges
between URLs. Distributed connected components over these edges make classes of aliases; a block rule
that fits any URL of a class, whether that URL has a page of its own or is named by an edge only, blocks
every alias in it, except pages that a rule allows explicitly. All is DataFrame functions.

Nulls: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed; null
html has no edges. Repeated URLs are one node. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithospark.llm.common import components, keep, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path), as the contract gives them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does. For rule lists of up to a few hundred."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """A URL as a node: host in lower case, no fragment."""
    rest = F.regexp_replace(_after(url), r"#.*$", "")
    return F.concat(F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?]*(?s:(.*))$", 1))


def link_targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page's canonical links and refresh redirects name."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1), lambda t: F.lower(t).contains("canonical") | F.lower(t).contains("refresh"))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b") & t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b") & t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh")), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*['\"]?([^\"'>\s]+)", 1))
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(_after(url), r"^([^/?#]*)", 1))

    def absolute(t: Column) -> Column:
        folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
        return (F.when(F.instr(t, "://") > 0, t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(origin, t))
                .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), t)))

    return F.transform(F.filter(F.concat(canonical, refresh), lambda t: t != ""), absolute)


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict. edges(src, dst) adds redirects known from elsewhere."""
    url = F.col("url")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": rule, "_explicit": verdict})
    links = pages.where(F.instr(url, "://") > 0).where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
    links = links.select(url.alias("src"), F.explode(link_targets(url, F.col("html"))).alias("dst"))
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst").where(F.instr("src", "://") > 0))
    links = keep(links.where(F.instr("dst", "://") > 0).select("src", "dst", F.xxhash64(node_of(F.col("src"))).alias("a"), F.xxhash64(node_of(F.col("dst"))).alias("b")), "links")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("_explicit", F.lit("allow")).alias("verdict"))
    classes = keep(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "aliases"), "aliases")
    named = links.select(F.col("src").alias("u"), F.col("a").alias("node")).unionByName(links.select(F.col("dst").alias("u"), F.col("b").alias("node"))).unionByName(pages.where(F.instr(url, "://") > 0).select(url.alias("u"), F.xxhash64(node_of(url)).alias("node")))
    blocked = named.where(rule_for(host_of(F.col("u")), path_of(F.col("u")), rules)[1] == "block").select("node").distinct()
    blocked = classes.join(blocked, "node").select("root").distinct()
    blocked = keep(classes.join(blocked, "root", "left_semi").select("node", F.lit(True).alias("_alias")), "blocked")
    out = judged.withColumn("node", F.xxhash64(node_of(url))).join(blocked, ["node"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_explicit", F.when(F.col("_alias"), "block"), F.lit("allow")).alias("verdict"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page judged by the four rules and the pages' own redirects."""
    return judge(table(spark, sf_dir, "pages"))


_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" % "{}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_SORTED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_PARTS = """SELECT *, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM {}"""
SQL = {
    "op5_url_filter": f"""
WITH RECURSIVE p AS (SELECT page_id, url, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ({_PARTS.format('pages')})),
link AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)(<link[^>]*>)', 1)) AS tag FROM pages WHERE instr(url, '://') > 0),
edge AS (SELECT src, regexp_extract(tag, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS dst FROM link WHERE regexp_matches(tag, '(?i)rel\\s*=\\s*["'']?canonical')),
both_ways AS (SELECT src, dst FROM edge WHERE instr(dst, '://') > 0 UNION SELECT dst, src FROM edge WHERE instr(dst, '://') > 0),
urls AS (SELECT src AS url FROM both_ways UNION SELECT url FROM pages WHERE url IS NOT NULL),
parts AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ({_PARTS.format('urls')})),
bad(url) AS (SELECT url FROM parts WHERE {_RULE.format(*[r[0] for r in _SORTED])} = 'block' UNION SELECT dst FROM bad JOIN both_ways ON src = url)
SELECT page_id, host, path, {_RULE.format(*[r[1] + r[2] for r in _SORTED])} AS rule,
  coalesce({_RULE.format(*[r[0] for r in _SORTED])}, CASE WHEN url IN (SELECT url FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""
}
