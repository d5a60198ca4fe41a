"""URL filters by redirect equivalence: block decisions reach all aliases of a page.

A url is judged by the longest rule that fits its host and path.  Redirects
(meta refresh) and canonical links found in the pages, and further edges the
caller has, join urls into components of aliases.  A url without a rule of
its own takes its component's decision: allow if any alias is explicitly
allowed, else block if any alias is explicitly blocked, else allow.

Aliases are urls without scheme and fragment and with a lower-case host.
Only urls that have an edge take part in the components; hosts may be hot,
as nothing is grouped by host.

Edge cases: a NULL url, or one without "://", has an empty host and path, no
rule and no alias, and is allowed; NULL html has no edges; repeated rows are
judged each; a link to the page itself is no edge; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.components import components

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ALIAS = "alias"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with its "?") of a url; empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return host, path, query


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL if none does."""
    rule = verdict = None
    for decision, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, what = F.lit(h + p), F.lit(decision)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def alias_of(url: Column) -> Column:
    """The url without scheme and fragment, NULL if it has no host."""
    host, path, query = split_url(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"']{name}{_ATTR}"
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def page_links(html: Column) -> Column:
    """Targets of the canonical links and meta refreshes of a page, as written."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\s[^>]*>)"), F.lit(1)),
                     lambda t: t.rlike(r"(?is)[\s\"']rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1)),
                     lambda t: t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    canonical = F.transform(links, lambda t: _attribute(t, "href"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(
        _attribute(t, "content"), r"(?is)url\s*=\s*['\"]?\s*([^'\"\s]+)", 1))
    wanted = F.filter(F.concat(canonical, refresh), lambda u: F.trim(u) != "")
    found = F.transform(wanted, lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&")))
    has = html.rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?refresh")
    return F.when(has, found).otherwise(F.expr("CAST(array() AS array<string>)"))


def resolve(link: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a whole url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .otherwise(F.concat(root, folder, link)))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): aliases joined by a canonical link or a redirect of a page."""
    rows = pages.select(F.col(url).alias("url"), F.explode(page_links(F.col(html))).alias("link"))
    return rows.select(alias_of(F.col("url")).alias("u"), alias_of(resolve(F.col("link"), F.col("url"))).alias("v"))


def judge(pages: DataFrame, edges: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the component (NULL without aliases)."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path, _ = split_url(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), alias_of(F.col("url")).alias("vertex"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "own": verdict})
    members = written(components(edges), "aliases")
    h, p, _ = split_url(F.concat(F.lit("x://"), F.col("vertex")))
    decided = members.withColumn("decision", rule_of(h, p, rules)[1]).groupBy("component").agg(
        F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked"))
    verdicts = decided.select("component", F.when(F.col("allowed"), "allow").when(
        F.col("blocked"), "block").otherwise("allow").alias("shared"))
    of_alias = members.join(verdicts, "component")
    return rows.join(of_alias, "vertex", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "shared", F.lit("allow")).alias("verdict"), "component")


def filter_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    edges = written(page_edges(pages), "links")
    return judge(pages, edges, rules)
