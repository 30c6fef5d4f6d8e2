"""URL filter with redirect equivalence.

Rules name a host and a path prefix. A page's own rule decides first, the longest one. A
page without a rule takes the decision of its aliases: URLs tied by redirects or canonical
links, to any depth, are one component, and a component that holds a blocked URL blocks
those of its URLs that have no rule of their own. An explicit allow is such a rule, so it
always stands.
"""

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paddock.llm.common import ascii_lower
from paddock.llm.components import components

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical\b)[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
BASE_TAG = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*['\"]?\s*([^\"'>\s]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path, without query and fragment; both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls. Of equally long ones the first stands."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def href_of(tag: Column) -> Column:
    """A tag's trimmed href, or null."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(tag, HREF, i)), F.lit("")) for i in (1, 2, 3)])


def joined(base: str, to: str) -> str | None:
    """The absolute URL that ``to`` names on a page at ``base``; None if there is none."""
    if ABSOLUTE.match(to):
        return to
    scheme, sep, rest = base.partition("://")
    if not sep or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", to):
        return None
    try:
        return scheme + urljoin(f"http://{rest}", to).removeprefix("http")
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolved(url: pd.Series, base: pd.Series, to: pd.Series) -> pd.Series:
    bases = (u if b is None else joined(u, b) or u for u, b in zip(url, base))
    return pd.Series([joined(b, t) for b, t in zip(bases, to)], dtype=object)


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target): all canonical links and refresh redirects that the pages' HTML states.

    Targets are resolved against the first <base href>, itself resolved against the page's URL, or against that URL.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    refresh = F.transform(every(REFRESH_TAG), lambda tag: F.nullif(F.regexp_extract(tag, REFRESH_URL, 1), F.lit("")))
    targets = F.concat(F.transform(every(LINK_TAG), href_of), refresh)
    named = href_of(F.regexp_extract(html, BASE_TAG, 0))
    some = pages.where(html.rlike("(?i)canonical|refresh"))
    found = some.select(F.col(url_col).alias("url"), named.alias("base"), F.explode(targets).alias("to")).where("url IS NOT NULL AND `to` IS NOT NULL")
    return found.select("url", resolved("url", "base", "to").alias("target")).where("target IS NOT NULL")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    ``redirects`` may add (url, target) rows to the links in the HTML. URLs count as one
    node when host and path agree. A null URL, or one without ://, has empty host and path
    and no alias: no rule fits it, so it is allowed. Repeated rows are judged each; an
    empty table gives an empty result. A page with neither rule nor blocked alias is allowed.
    """
    host, path = host_and_path(F.col(url_col))
    page = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = page.withColumns({"rule": rule, "own": verdict, "node": node_of(F.col("host"), F.col("path"))})
    links = alias_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    edge = links.select(node_of(*host_and_path(F.col("url"))).alias("a"), node_of(*host_and_path(F.col("target"))).alias("b")).where("a <> '' AND b <> ''")
    alias = components(edge)
    at_host, at_path = F.substring_index("node", "/", 1), F.regexp_extract("node", r"(?s)^[^/]*(.*)$", 1)
    alias = alias.withColumn("own", rule_of(at_host, at_path, rules)[1])
    blocked = alias.where("own = 'block'").select("component").distinct()
    reached = alias.where("own IS NULL").join(blocked, "component", "left_semi").select(F.col("node").alias("bad"))
    out = page.join(reached, page.node == reached.bad, "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad").isNotNull(), "block"), F.lit("allow")).alias("verdict"))


def node_of(host: Column, path: Column) -> Column:
    """One text for both; a host has no slash and a path starts with one, so it can be taken apart again."""
    return F.concat(host, path)
