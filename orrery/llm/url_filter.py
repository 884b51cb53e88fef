"""URL filters: host and path rules, whose block decisions reach aliases through redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, cut, table
from orrery.operators.components import connected_components

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MAX_RULES = 1000  # rules in the plan itself; longer lists come as a DataFrame and are joined

CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """An address without scheme and fragment; null if it has no `://`."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), tail))


def with_rule(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """pages(host, path) plus the longest fitting rule and its verdict (null: none fits)."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if isinstance(rules, list):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules: give more than {MAX_RULES} as a DataFrame (rule, verdict)")
        fits = []
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            ok = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
            fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
        kind = "struct<n: int, rule: string, verdict: string>"
        best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast(kind)
        return pages.withColumn("_best", best).select(*pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))
    parts = rules.select(F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substr(rule, instr(rule, '/'))").alias("start"), "rule", "verdict")
    keys = pages.select("host", "path").distinct()
    hit = keys.withColumn("suffix", F.explode(suffixes)).join(parts, "suffix").filter(F.expr("startswith(path, start)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))


def links_of(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that a page's canonical link or refresh makes aliases of its own."""
    html = F.coalesce(F.col("html"), F.lit(""))
    canonical = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), REFRESH_URL, 1)
    base = F.col("url")
    each = pages.filter(F.instr(base, "://") > 0).select(base, F.explode(F.array(canonical, refresh)).alias("to")).filter("to <> ''")
    to = F.regexp_replace("to", "&amp;", "&")
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?://)", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/") & (folder != scheme), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = F.when(F.instr(to, "://") > 0, to).when(to.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), to)).when(to.startswith("/"), F.concat(host, to)).otherwise(F.concat(folder, to))
    return each.select(node_of(base).alias("a"), node_of(whole).alias("b")).filter("a <> b")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, html).

    The longest rule that fits the page's own url decides. A page that none fits is blocked if an alias of it (an
    address linked to it by any chain of redirects(url, target) and canonical or refresh links, crawled or not) is
    blocked by a rule and none is explicitly allowed; else it is allowed. Null url: empty host and path, no aliases,
    allowed. Repeated rows get equal rows. No pages: no rows. Further columns are ignored.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links_of(own)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("url")), node_of(F.col("target"))))
    edges = cut(edges.filter("a is not null and b is not null and a <> b"), "url-edges")
    judged = with_rule(own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    comp = cut(connected_components(edges), "url-components")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    members = with_rule(comp.select("node", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules)
    said = members.groupBy("component").agg(F.max((F.col("verdict") == "block").cast("int")).alias("b"), F.max((F.col("verdict") == "allow").cast("int")).alias("a"))
    bad = said.filter("b = 1 and coalesce(a, 0) = 0").select("component", F.lit("block").alias("spread"))
    bad = cut(comp.join(bad, "component").select("node", "spread"), "url-bad")
    out = judged.withColumn("node", node_of(F.col("url"))).join(bad, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit("allow")).alias("verdict"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


def _oracle() -> str:
    fits = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    case = lambda i, end: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + f" ELSE {end} END"
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {case(1, "NULL")} AS rule, {case(2, "'allow'")} AS verdict FROM p
"""


ORACLE = _oracle()
