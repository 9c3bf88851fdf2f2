"""URL filters over classes of equivalent addresses.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule decides. An
address without a rule of its own takes the decision of its class: addresses are joined by redirect edges (a refresh in
the page, or rows of a given redirect table) and by canonical-link edges (a canonical link in the page, and the address's
own canonical form: no scheme, no ``www.`` or ``m.``, no fragment, no tracking parameters, no trailing slash). Targets
are resolved against the page's base (its address, or a base element), redirects against their source; targets of other
kinds (``mailto:``) are none. Classes are the connected components of those edges; only addresses, not canonical forms,
are judged by the rules. In a class, an explicit allow of any member goes before blocks of others:
the order for an address is its own rule, an allow in its class, a block in its class, the default.

All of it is DataFrame work: expressions for parsing, joins and aggregations for the classes.

Defined cases: a null address, or one without ``://``, has an empty host and path, fits no rule, has no edges and takes the
default verdict; equal addresses are judged alike, each row is returned; an empty table gives an empty table; html may be
null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graphs import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

CANONICAL_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = (
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*"""
    r"""(?:"[^">]*?\burl\s*=\s*'?\s*|'[^'>]*?\burl\s*=\s*"?\s*|[^"'\s>]*?\burl\s*=)([^"'\s>]+)"""
)
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without what doesn't tell pages apart; null where there is no ``://``."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.trim(F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", ""), F.lit("&"))
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def without_dots(path: Column) -> Column:
    """A path from ``/`` on without its ``.`` and ``..`` segments."""
    parts = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, x)),
    )
    return F.concat(F.array_join(parts, "/"), F.when(path.rlike(r"(?s)/\.\.?$"), "/").otherwise(""))


def resolve(target: Column, base: Column) -> Column:
    """The address a target means in a document at ``base``; null where it is empty, a mere fragment or no address."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)", 1))
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)") | ~F.contains(base, F.lit("://")), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(path == "", F.concat(root, path_of(base), rest))
        .otherwise(F.concat(root, without_dots(whole), rest))
    )


def address(url: Column) -> Column:
    """A node of the edge table for an address; null where there is no ``://``."""
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("a "), url))


def form(url: Column) -> Column:
    """A node for a canonical form, which never equals an address, though it may hold ``://`` in its query."""
    return F.concat(F.lit("f "), canonical(url))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's string and action; null where none fits."""
    rule = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        action = F.when(fits, act).otherwise(action)
    return rule, action


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, reason for every page; redirects: src, dst addresses."""
    url = F.col("url")
    home = F.coalesce(resolve(F.regexp_extract("html", BASE, 1), url), url)
    found = F.array(F.regexp_extract("html", CANONICAL_LINK, 1), F.regexp_extract("html", REFRESH, 1))
    linked = pages.where(F.contains(url, F.lit("://"))).select(url.alias("u"), home.alias("home"), F.filter(found, lambda x: x != "").alias("found"))
    links = linked.select("u", F.explode("found").alias("v"), "home").select("u", resolve(F.col("v"), F.col("home")).alias("v"))
    ends = linked.select("u")
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("src").alias("u"), resolve(F.col("dst"), F.col("src")).alias("v")))
        ends = ends.unionByName(redirects.select(F.col("src").alias("u")))
    edges = links.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v"))
    edges = edges.unionByName(ends.unionByName(links.select(F.col("v").alias("u"))).select(address(F.col("u")).alias("u"), form(F.col("u")).alias("v")))
    classes = components(edges).select("component", F.left("node", F.lit(2)).alias("kind"), F.substring("node", 3, 1 << 30).alias("node"))
    classes = classes.where("kind = 'a '")

    rule, action = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    members = classes.select("component", action.alias("action"))
    decided = members.groupBy("component").agg(
        F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked")
    ).where("allowed or blocked")
    inherited = classes.join(decided, "component").select(
        F.col("node").alias("member"), F.when(F.col("allowed"), "allow").otherwise("block").alias("of_class")
    )
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumns({"rule": rule, "action": action})
        .join(inherited, F.col("url") == F.col("member"), "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("action", "of_class", F.lit(default)).alias("verdict"),
            F.when(F.col("action").isNotNull(), "rule").when(F.col("of_class").isNotNull(), "alias").otherwise("default").alias("reason"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parsed AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '^(?:.*?)://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?:.*?)://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^(?:.*?)://[^?#]*\?([^#]*)', 1, 's'), '') AS query
  FROM pages),
formed AS (
  SELECT *, trim(regexp_replace('&' || query, '&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '&') AS kept FROM parsed),
keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS form
  FROM formed),
judged AS (
  SELECT k.*, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY page_id, url ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM (SELECT DISTINCT page_id, url, host, path, form FROM keyed) k
  LEFT JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
own AS (SELECT * FROM judged WHERE place = 1),
classes AS (SELECT form, bool_or(action = 'allow') AS allowed, bool_or(action = 'block') AS blocked FROM own GROUP BY form)
SELECT k.page_id, k.host, k.path, o.rule,
       coalesce(o.action, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' END, 'allow') AS verdict,
       CASE WHEN o.action IS NOT NULL THEN 'rule' WHEN c.allowed OR c.blocked THEN 'alias' ELSE 'default' END AS reason
FROM keyed k JOIN own o ON k.page_id IS NOT DISTINCT FROM o.page_id AND k.url IS NOT DISTINCT FROM o.url
LEFT JOIN classes c ON k.form = c.form
"""
