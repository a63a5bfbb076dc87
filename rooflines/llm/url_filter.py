"""URL filters with redirect equivalence, in DataFrame functions only.

Rules (host, path, action) fit a host and its subdomains where the url's path starts with the rule's; the longest
wins. Urls that redirect to one another or name one another as canonical form classes, found as connected components
over those edges (from the pages' html and, if given, a table of redirects). A page that no rule fits takes its
class's decision: allow if a rule allows any member, else block if a rule blocks any, else allow. A rule that fits a
page itself always stands.

Defined cases: a null url, or one without ://, has empty host and path, fits no rule and has no edges; null html names
no edges; rows that are the same are each judged; an empty table gives no rows; extra columns are ignored; rules of
equal length (same host and path) are settled for allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, host_and_path, read
from .components import connected_components

#: The query's rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Up to so many rules become one expression; more are joined by host suffix.
MOST_IN_LINE = 200
#: Whole tags, or what an unclosed one leaves of the text, so that each letter is read once; then what one must say.
LINK, META = r"(?i)<link\b[^>]*(?:>|\z)", r"(?i)<meta\b[^>]*(?:>|\z)"
CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def _name(host: str, path: str) -> str:
    return host + path


def _in_line(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for h, p, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(_name(h, p)).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def judge_by_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (key, url): adds host, path, rule and action, both null where no rule fits. A DataFrame of rules is joined."""
    host, path = host_and_path(F.col("url"))
    split = urls.withColumn("host", host).withColumn("path", path)
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_IN_LINE:
        return split.withColumn("__r", _in_line(F.col("host"), F.col("path"), rules)).select("*", "__r.rule", "__r.action").drop("__r")
    table = rules if isinstance(rules, DataFrame) else urls.sparkSession.createDataFrame(rules, "host string, path string, action string")
    table = table.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "action")
    # one row for each host and suffix of it, not for each url: a host with very many urls is looked up once
    labels = F.split("host", r"\.")
    suffixes = split.select("host").distinct().withColumn("__s", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    by_host = suffixes.join(table, F.col("__s") == F.col("__h")).groupBy("host").agg(F.collect_list(F.struct((F.length("__h") + F.length("__p")).alias("n"), (F.col("action") != "allow").cast("int").alias("last"), "__h", "__p", "action")).alias("__rules"))
    fits = F.filter("__rules", lambda r: F.col("path").startswith(r["__p"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], (-r["last"]).alias("first"), F.concat(r["__h"], r["__p"]).alias("rule"), r["action"].alias("action"))))
    return split.join(by_host, "host", "left").withColumn("__r", best).select(*split.columns, "__r.rule", "__r.action")


def _without_dots(url: Column) -> Column:
    """url with the segments . and .. of its path taken out, as browsers do."""
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"([?#].*)$", 1)
    parts = F.split(path, "/")
    ends = F.element_at(parts, -1).isin(".", "..")
    climb = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p)))
    clean = F.aggregate(parts, F.array().cast("array<string>"), climb)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(site, F.array_join(clean, "/"), F.when(ends, "/").otherwise(""), rest)).otherwise(url)


def _absolute(base: Column, link: Column) -> Column:
    """link as seen from base: absolute, //host, /path, ?query or relative to base's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link)).when(link.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), link)).otherwise(F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), link))


def page_links(pages: DataFrame) -> DataFrame:
    """u, v: each page's url and the url that its canonical link or refresh names."""
    first = lambda tag, says: F.get(F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.endswith(">") & t.rlike(says)), 0)
    found = F.array(F.regexp_extract(first(LINK, CANONICAL), HREF, 1), F.regexp_extract(first(META, REFRESH), TARGET, 1))
    named = pages.where(F.col("url").contains("://") & (F.lower(F.col("html")).contains("canonical") | F.lower(F.col("html")).contains("refresh"))).select("url", F.explode(found).alias("link")).where("link <> ''")
    return named.select(F.col("url").alias("u"), _without_dots(_absolute(F.col("url"), F.regexp_replace("link", "(?i)&amp;", "&"))).alias("v"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_verdict (null where the page's class has no decision) for each row of pages."""
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col(redirects.columns[0]).alias("u"), F.col(redirects.columns[1]).alias("v")))
    edges = cut(edges)
    judged = judge_by_rules(pages.select("page_id", "url"), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_verdict"))
    classes = connected_components(edges)
    # aliases that are no pages of the table count by the rules as well
    own = judge_by_rules(classes.withColumnRenamed("node", "url"), rules)
    decided = own.groupBy("component").agg(F.bool_or(F.col("action") == "allow").alias("allow"), F.bool_or(F.col("action") == "block").alias("block"))
    of_class = F.when(F.col("allow"), "allow").when(F.col("block"), "block")
    by_url = classes.join(decided.select("component", of_class.alias("alias_verdict")), "component").where("alias_verdict is not null").select(F.col("node").alias("__url"), "alias_verdict")
    return judged.join(by_url, F.col("url") == F.col("__url"), "left").select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_ACTION = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for h, p, a in RULES)


def _judged(table: str) -> str:
    return f"""SELECT *, CASE rule {_ACTION} END AS action FROM (SELECT *, CASE {_FITS} END AS rule FROM (
SELECT *, {_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1, 's')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table})))"""


#: Absolute links only: the synthetic pages name none, and relative ones are tested apart.
ORACLES = {
    "op6_url_filter": f"""
WITH RECURSIVE links AS (
  SELECT url AS u, regexp_extract(regexp_extract(html, '<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'i'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i') AS v FROM pages WHERE contains(url, '://')
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'i'), '\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1, 'i') FROM pages WHERE contains(url, '://')),
e AS (SELECT u, v FROM links WHERE v <> '' UNION SELECT v, u FROM links WHERE v <> ''),
reach(a, b) AS (SELECT u, v FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u),
alias AS (SELECT a AS url, bool_or(action = 'allow') AS allow, bool_or(action = 'block') AS block FROM ({_judged("(SELECT a, b AS url FROM reach)")}) GROUP BY a),
j AS ({_judged("(SELECT page_id, url FROM pages)")})
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN allow THEN 'allow' WHEN block THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN alias ON j.url = alias.url""",
}
