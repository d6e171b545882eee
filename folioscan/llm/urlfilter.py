"""URL block and allow rules, carried over redirects and canonical links."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import written
from folioscan.llm.components import connected_components
from folioscan.session import ship

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAG = re.compile(r"""<(base|link|meta)\b((?:"[^"]*"|'[^']*'|[^>])*+)>""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: As in attributes: a name without its semicolon counts only before other than a letter, digit or ``=``.
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")
_REFRESH = re.compile(r"\s*(?:[\d.]+\s*(?:[;,\s]\s*|$)|(?=url\s*=))(?:url\s*=\s*)?(.*)$", re.I | re.S)
_ABSOLUTE = re.compile(r"[a-z][a-z0-9+.-]*://", re.I)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """Hash of what a url names: A-Z of scheme and host lower-cased, without its fragment."""
    plain = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)?([^#]*)", 1), F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)?([^#]*)", 2)
    return F.xxhash64(F.concat(F.translate(plain[0], _UPPER, _LOWER), plain[1]))


def fitted(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _unescaped(value: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0]), value)


def _resolved(base: str, link: str) -> str | None:
    """The absolute url of a link, or null; an absolute link stays as it is written."""
    link = re.sub(r"[\t\r\n]", "", link).strip()
    try:
        out = link if not link or _ABSOLUTE.match(link) else urljoin(base, link)
    except ValueError:
        return None
    return out if _ABSOLUTE.match(out) else None


def targets(url: str, markup: str) -> list[str]:
    """Urls of all canonical links and refreshes of a page: entities unescaped,
    relative ones resolved against the first ``base`` or else the page's url."""
    base, links = None, []
    for tag, inner in _TAG.findall(markup):
        own: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(inner):
            own.setdefault(name.lower(), _unescaped("".join(values)))
        tag = tag.lower()
        if tag == "base" and base is None and "href" in own:
            base = _resolved(url, own["href"])
        elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
            links.append(own.get("href", ""))
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(own.get("content", ""))):
            goal = m[1].strip()
            links.append(goal[1:].split(goal[0])[0] if goal[:1] in ("'", '"') and goal else goal)
    return [u for link in links if (u := _resolved(base or url, link))]


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): all canonical links and refreshes in the pages' markup, as absolute
    urls; only pages that name one leave the JVM."""
    ship(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["src", "dst"])

    flat = pages.select(F.col(url_col).alias("src"), F.col(html_col).alias("html")).where(F.col("src").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    return flat.mapInArrow(run, "src string, dst string")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component for every page.

    A rule that fits the page's own url decides, so an explicit allow is never
    overruled.  A page without a rule is blocked if any url that redirects or
    canonical links (all of them in ``html``, resolved against the page's url, and
    ``redirects`` with columns src, dst, taken as absolute) connect to it is blocked by a rule and no url of that set is allowed by one;
    otherwise it is allowed.  Urls are connected by their hash (see ``node_of``: hosts in
    any case and fragments don't part them) in rounds that shuffle ids alone; only urls with links enter them.

    Null urls and urls without ``://`` have empty host and path, fit no rule and
    are allowed; repeated rows and pages of one url are judged each; null and empty markup has no
    links; other columns, of whatever name, are ignored; an empty table gives no rows.
    """
    links = written(page_links(pages, url_col, html_col), "links")
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    ids = links.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b"))
    comp = connected_components(ids, "a", "b")
    urls = links.select("src").union(links.select("dst")).distinct()
    rule = lambda c: fitted(host_of(c), path_of(c), rules)
    known = urls.select(node_of(F.col("src")).alias("node"), rule(F.col("src")).verdict.alias("v")).join(comp, "node")
    decided = known.groupBy("component").agg(F.bool_or(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocks"), F.bool_or(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allows"))
    aliased = comp.join(decided, "component").select("node", "component", (F.col("blocks") & ~F.col("allows")).alias("alias_block"))
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("page_id"), node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path"), rule(url).alias("fit"))
    method = F.when(F.coalesce(F.col("alias_block"), F.lit(False)), "block").otherwise("allow")
    return own.join(aliased, "node", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "component")
