"""URL rules with redirect equivalence (operator 9, DataFrame functions only).

Nodes are addresses (host, path and query), edges are canonical links and
redirects, after whatever delay, found in the pages, and those of a crawl log if one is given.
Connected components of those edges are groups of aliases.  With ``spellings`` addresses
are also one that servers usually redirect to each other (www and m hosts, /x and
/x.html, tracking parameters); no page says so, so it is off unless asked for.  A page that a rule fits keeps that rule's verdict.
Every other page takes the decision of its group: an explicit allow of any
alias wins over a block, a block wins over nothing, and a group without
decisions is allowed.

Defined cases: a null address, or one without ``://``, has an empty host and
path, fits no rule, has no aliases and is allowed; null html has no links;
repeated rows are judged alike; a null page_id is kept; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table
from .components import connected_components

#: Fixed rules of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Patterns that Java and RE2 read alike.  A tag first, then its address.
LINK = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["'\s/>][^>]*"""
HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
META = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["'\s][^>]*"""
GOTO = r"""(?is)content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""
#: The SQL reads redirects without delay only.
GOTO_AT_ONCE = r"""(?is)content\s*=\s*["']?\s*0*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""
#: Query parameters that never change what an address shows.
TRACKING = r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?"
#: Parts of an address that servers redirect away.
HOST_ALIAS, PATH_ALIAS = r"^(www|m)\.", r"(/index)?(\.html?)?/*$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where the address is null or has no ``://``."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column, spellings: bool = False) -> Column:
    """One name for an address, or for all spellings that servers usually redirect to it; null if it is no address."""
    host, path = host_and_path(url)
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    if spellings:
        asked = F.regexp_replace(F.regexp_replace(asked, TRACKING, ""), "^&", "")
        host, path = F.regexp_replace(host, HOST_ALIAS, ""), F.regexp_replace(path, PATH_ALIAS, "")
    else:
        path = F.when(path == "", "/").otherwise(path)
    return F.when(host_and_path(url)[0] != "", F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def resolve(url: Column, link: Column) -> Column:
    """The absolute address of a link on a page."""
    host, path = host_and_path(url)
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), host)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.regexp_replace(path, r"[^/]*$", ""), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html", spellings: bool = False) -> DataFrame:
    """(a, b) of alias keys: each page and the targets of its canonical link and redirect."""
    found = [F.regexp_extract(F.regexp_extract(F.col(html), tag, 0), target, 1) for tag, target in ((LINK, HREF), (META, GOTO))]
    one = pages.select(F.col(url).alias("u"), F.array(*found).alias("links")).where("exists(links, x -> x <> '')")
    return (
        one.select("u", F.explode("links").alias("link"))
        .where("link <> ''")
        .select(alias_key(F.col("u"), spellings).alias("a"), alias_key(resolve(F.col("u"), F.col("link")), spellings).alias("b"))
        .where("a <> b")
    )


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does.  Among equals an allow wins."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in order
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", spellings: bool = False
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page.  ``links`` (a, b) are further redirects between addresses, as from a crawl log."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), alias_key(F.col(url), spellings).alias("key"))
    seen = seen.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    edges = page_links(pages, url, html, spellings)
    if links is not None:
        edges = edges.unionByName(links.select(alias_key(F.col("a"), spellings).alias("a"), alias_key(F.col("b"), spellings).alias("b")))
    with Scratch(spark, "urls") as scratch:
        groups = connected_components(scratch.put(edges.distinct()), scratch).select(F.col("node").alias("key"), "component")
        rows = scratch.put(seen.select("page_id", "host", "path", "r", "key"))
        # Decisions are combined per key before they meet the groups: a host with a third of all pages sends a row per key and task.
        decided = rows.where("r is not null and key is not null").groupBy("key").agg(F.bool_or(F.col("r.verdict") == "allow").alias("allow"))
        decided = decided.join(groups, "key", "left").groupBy(F.coalesce("component", "key").alias("component")).agg(F.bool_or("allow").alias("allow"))
        open_keys = rows.where("r is null and key is not null").select("key").distinct().join(groups, "key", "left")
        fate = open_keys.withColumn("component", F.coalesce("component", "key")).join(decided, "component").select("key", "allow")
        out = rows.join(fate, "key", "left").select(
            "page_id",
            "host",
            "path",
            F.col("r.rule").alias("rule"),
            F.coalesce(F.col("r.verdict"), F.when(~F.col("allow"), "block").otherwise("allow")).alias("verdict"),
        )
        return scratch.keep(out)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    abc = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
    host = lambda u: f"translate(regexp_extract(CASE WHEN contains({u},'://') THEN substr({u},instr({u},'://')+3) ELSE '' END,'^[^/?#]*'),{abc})"
    path = lambda u: f"regexp_extract(CASE WHEN contains({u},'://') THEN substr({u},instr({u},'://')+3) ELSE '' END,'^[^/?#]*([^?#]*)',1)"
    asked = lambda u: f"regexp_extract({u},'^[^?#]*\\?([^#]*)',1)"
    key = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || CASE WHEN {asked(u)} <> '' THEN '?' || {asked(u)} ELSE '' END END"
    rules = reduce(lambda a, b: f"{a} UNION ALL {b}", (f"SELECT {q(v)} v, {q(h)} h, {q(p)} p" for v, h, p in RULES))
    return f"""
WITH RECURSIVE pg AS (
  SELECT page_id, coalesce(url,'') AS url, {host("coalesce(url,'')")} AS host, {path("coalesce(url,'')")} AS path, coalesce(html,'') AS html FROM pages),
rules AS ({rules}),
fit AS (SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM pg JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url),
raw AS (
  SELECT url, host, path, replace(regexp_extract(regexp_extract(html,{q(LINK)}),{q(HREF)},1),'&amp;','&') AS l FROM pg
  UNION ALL SELECT url, host, path, replace(regexp_extract(regexp_extract(html,{q(META)}),{q(GOTO_AT_ONCE)},1),'&amp;','&') FROM pg),
res AS (SELECT url, CASE WHEN contains(l,'://') THEN l WHEN starts_with(l,'//') THEN 'http:' || l WHEN starts_with(l,'/') THEN 'http://' || host || l
  ELSE 'http://' || host || regexp_replace(path,'[^/]*$','') || l END AS l FROM raw WHERE l <> ''),
arcs AS (SELECT DISTINCT {key("url")} AS a, {key("l")} AS b FROM res),
both_ways AS (SELECT a, b FROM arcs WHERE a <> b UNION SELECT b, a FROM arcs WHERE a <> b),
keyed AS (SELECT pg.page_id, pg.host, pg.path, fit.rule, fit.v, {key("pg.url")} AS k FROM pg LEFT JOIN fit ON pg.page_id = fit.page_id AND pg.url = fit.url),
reach(k, o) AS (SELECT DISTINCT k, k FROM keyed WHERE k IS NOT NULL UNION SELECT r.k, e.b FROM reach r JOIN both_ways e ON r.o = e.a),
fate AS (SELECT r.k, bool_or(d.v = 'allow') AS yes FROM reach r JOIN keyed d ON d.k = r.o WHERE d.v IS NOT NULL GROUP BY r.k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN NOT yes THEN 'block' ELSE 'allow' END) AS verdict FROM keyed LEFT JOIN fate ON keyed.k = fate.k"""


QUERIES = {"op9_url_filters": op9_url_filters}
SQL = {"op9_url_filters": _sql()}
