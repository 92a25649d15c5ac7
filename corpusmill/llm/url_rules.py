"""URL block rules with redirect equivalence, in DataFrame operations only.

A rule decides the URLs of its host and subdomains under its path. URLs that
a redirect or a canonical link ties together are aliases of one another: a
block spreads to the aliases that no rule decides, unless one of them is
explicitly allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.shared import written

#: Verdict, host and path of each rule.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"


def url_host(url: Column) -> Column:
    return F.translate(_part(url, 2), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return _part(url, 3)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, group)


def url_key(url: Column) -> Column:
    """The URL without fragment, scheme and host in small letters; null without ``://``."""
    scheme = F.translate(_part(url, 1), _UPPER, _LOWER)
    key = F.concat(scheme, F.lit("://"), url_host(url), _part(url, 3), _part(url, 4))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), key)


def _attribute(html: Column, tag: str, attribute: str) -> Column:
    element = F.regexp_extract(html, tag, 0)
    value = F.regexp_extract(element, rf"(?is)\b{attribute}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def _absolute(target: Column, url: Column) -> Column:
    """The target of a link as seen from ``url``; null if there is none."""
    scheme = _part(url, 1)
    site = F.concat(scheme, F.lit("://"), _part(url, 2))
    folder = F.regexp_replace(_part(url, 3), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, folder, target))
    )


CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: the URL keys that a page's canonical link and refresh redirect tie together."""
    url, html = F.col(url_col), F.col(html_col)
    found = pages.where(html.rlike(r"(?i)canonical|refresh")).select(
        url_key(url).alias("a"),
        url.alias("url"),
        F.explode(F.array(_attribute(html, CANONICAL, "href"), _attribute(html, REFRESH, "url"))).alias("to"),
    )
    return found.select("a", url_key(_absolute(F.col("to"), F.col("url"))).alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL AND a != b"
    )


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, both null if none does.

    Of equally long rules that fit, an allowing one wins. The rules are a
    short list that becomes one expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))

    def named(rule, verdict):
        return F.struct(rule.cast("string").alias("rule"), verdict.cast("string").alias("verdict"))

    def step(rest: Column, one: tuple[str, str, str]) -> Column:
        verdict, rule_host, rule_path = one
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        return F.when(fits, named(F.lit(rule_host + rule_path), F.lit(verdict))).otherwise(rest)

    return reduce(step, reversed(ordered), named(F.lit(None), F.lit(None)))


def judged(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", redirects: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule, verdict.

    ``redirects`` may add ``(a, b)`` pairs of URLs, as a crawl log has them.
    A URL that no rule fits is blocked if one of its aliases, pages of the
    table or not, has a blocking rule and none has an allowing one; else it
    is allowed. Null and malformed URLs have empty host and path, no rule and
    no alias, and are allowed. Rows that repeat a URL get one verdict. Null
    html ties nothing. Other columns are not read.
    """
    links = page_links(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    if redirects is not None:
        links = links.union(redirects.select(url_key(F.col("a")), url_key(F.col("b"))))
    groups = written(components(links), "aliases")
    own = matched_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"]
    blocked = (
        groups.select("component", own.alias("verdict"))
        .groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
        .where("block AND NOT coalesce(allow, false)")
    )
    bad = groups.join(blocked, "component").select(F.col("node").alias("key"), F.lit(True).alias("bad"))
    rows = pages.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"), url_key(F.col(url_col)).alias("key"),
    ).withColumn("own", matched_rule(F.col("host"), F.col("path"), rules))
    return rows.join(bad, "key", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"),
    )
