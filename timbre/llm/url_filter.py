"""URL filters with redirect equivalence.

Rules name a host (with its subdomains) and a path prefix.  A rule that fits an
address decides it.  Addresses that redirects or canonical links tie together
form one class, found by distributed connected components: a block decision
spreads to all members that no rule decides, unless a rule explicitly allows a
member of the class; allow takes precedence.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize

#: action, host, path
Rule = tuple[str, str, str]

#: rel with canonical among its values
_CANONICAL = r"""(?is)(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]|$))"""
_LINK = r"(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """An address as a node: host, path and query, without scheme and fragment; null without ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), query))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    _, r_host, r_path = rule
    return ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)


def _length(rule: Rule) -> tuple:
    return len(rule[1]) + len(rule[2]), len(rule[1]), rule[0] == "allow"


def rule_index(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the longest fitting rule, or null.  The rules are a short fixed list."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: _length(rules[i]), reverse=True):
        fits = _fits(host, path, rules[i])
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def resolve(url: str | None, base: str | None, target: str | None) -> str | None:
    """The address that a link's target means on the page ``url``, whose base element names ``base``; null where it means none."""
    if not url or not target:
        return None
    target = html.unescape(target)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", target):
        return target
    try:
        return urljoin(urljoin(url, html.unescape(base or "")), target)
    except ValueError:
        return None


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) node pairs from the canonical links and meta refreshes of ``pages(url, html)``.

    Entities are decoded; relative targets are resolved against the page's base element or address.
    """
    base = F.regexp_extract("html", r"(?is)<base\b[^>]*?\shref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    tags = pages.where(F.col("html").rlike(_LINK)).select("url", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(f"({_LINK})"), F.lit(1))).alias("tag"))
    canonical = F.col("tag").rlike(_CANONICAL)
    refresh = F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh")
    href = F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    to = F.regexp_extract("tag", r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    target = F.when(canonical, href).when(refresh, to)
    full = F.udf(resolve, "string", useArrow=True)("url", "base", target)
    tags = tags.select("url", full.alias("full"))
    return tags.select(node_of(F.col("url")).alias("a"), node_of(F.col("full")).alias("b")).where("a is not null and b is not null and a != b")


def url_filter(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, via_alias) for each row of ``pages(page_id, url, ...)``.

    ``edges(a, b)`` are equivalent urls (redirects); None reads none beside the
    pages' own links, which need a column html.  ``verdict`` is the rule's; else
    block when the url's class holds a blocked address and no explicitly allowed one;
    else ``default``.  Addresses at an edge that no page has count too.  A null
    url, or one without ``://``, has empty host and path, fits no rule with a
    host, and has no aliases.  Repeated rows are judged alike; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    found = []
    if "html" in pages.columns:
        found.append(link_edges(pages.select("url", "html")))
    if edges is not None:
        found.append(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("i", rule_index(F.col("host"), F.col("path"), rules))
    names = F.array(*(F.lit(h + p) for _, h, p in rules)) if rules else F.array().cast("array<string>")
    actions = F.array(*(F.lit(a) for a, _, _ in rules)) if rules else F.array().cast("array<string>")
    judged = judged.withColumns({"rule": F.get(names, F.col("i")), "action": F.get(actions, F.col("i"))})
    links = None
    for e in found:
        links = e if links is None else links.unionByName(e)
    links = materialize(links.distinct()) if links is not None else None
    if links is None or not links.limit(1).count():
        spread = judged.withColumn("alias_block", F.lit(False))
    else:
        comps = materialize(connected_components(links))
        # each address of a class is judged by its own host and path
        at = comps.withColumn("url", F.concat(F.lit("x://"), "node"))
        at = at.withColumn("i", rule_index(host_of(F.col("url")), path_of(F.col("url")), rules)).withColumn("action", F.get(actions, F.col("i")))
        classes = at.groupBy("comp").agg(F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("b"), F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("a"))
        blocked = comps.join(classes.where("b and not a"), "comp").select("node", F.lit(True).alias("alias_block"))
        spread = judged.join(blocked, "node", "left")
    via = F.col("action").isNull() & F.coalesce(F.col("alias_block"), F.lit(False))
    verdict = F.coalesce("action", F.when(via, F.lit("block")).otherwise(F.lit(default)))
    return spread.select("page_id", "host", "path", "rule", verdict.alias("verdict"), via.alias("via_alias"))
