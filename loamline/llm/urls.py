"""URL filters by host and path rules, with block decisions carried over redirects, DataFrame operations
only.

A url that some rule fits has the verdict of the longest such rule, so an explicit allow always stands.
Other urls take the decision of their component: addresses joined by canonical links and by redirects
(meta refresh in the page, or a table of redirects) are one resource. A component with an explicitly
allowed address is allowed, else one with a blocked address is blocked, else it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, pick
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
#: Up to so many rules are one expression; more are joined by host.
MAX_INLINE = 200
Rule = tuple[str, str, str]  # verdict, host, path


def url_part(url: Column, n: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, n), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(url_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return url_part(url, 2)


def address_of(url: Column) -> Column:
    """Host, path and query; neither scheme nor fragment. Null if there is no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), url_part(url, 3)))


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """pages (with host and path) plus rule_at, the number of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][1], rules[i][2], rules[i][0]))
    if len(rules) <= MAX_INLINE:
        found = F.lit(None).cast("int")
        for i in reversed(order):
            _, host, path = rules[i]
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            found = F.when(fits, i).otherwise(found)
        return pages.withColumn("rule_at", found)
    spark = pages.sparkSession
    listed = spark.createDataFrame([(n, i, rules[i][1], rules[i][2]) for n, i in enumerate(order)], "rank int, at int, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    places = pages.select("host", "path").distinct()
    parents = places.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("rule_host"))
    best = parents.join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.min_by("at", "rank").alias("rule_at"))
    return pages.join(best, ["host", "path"], "left")


def target_of(url: Column, link: Column) -> Column:
    """link as seen from url: whole, without scheme, from the root, or beside the page."""
    origin = F.concat(F.lit("x://"), host_of(url))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, F.regexp_extract(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"(?s)^(.*/)", 1), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) address pairs of the pages' canonical links and meta refreshes; pages has url and html."""
    html, url = F.col("html"), F.col("url")
    attribute = lambda tag, name: F.coalesce(F.nullif(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1), F.lit("")), F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*([^\s"'>]+)""", 1))
    links = F.when(html.rlike("(?i)canonical"), F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b""")))
    metas = F.when(html.rlike("(?i)http-equiv"), F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b""")))
    none = F.array().cast("array<string>")
    targets = F.concat(
        F.transform(F.coalesce(links, none), lambda t: attribute(t, "href")),
        F.transform(F.coalesce(metas, none), lambda t: F.trim(F.regexp_replace(F.regexp_extract(attribute(t, "content"), r"(?is)\burl\s*=\s*(.*)$", 1), "[\"']", ""))),
    )
    found = pages.select("url", F.explode(targets).alias("link")).select(address_of(url).alias("a"), address_of(target_of(url, F.col("link"))).alias("b"))
    return found.where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict and via ('rule', 'alias' or 'default') of each row.

    redirects: (from_url, to_url). A null url or one without ``://`` has an empty host and path, no rule,
    no address, and verdict allow. Null html has no links. Repeated rows come out as often as they go in;
    extra columns are left out; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    edges = alias_edges(rows)
    if redirects is not None:
        more = pick(redirects, a="from_url", b="to_url").select(address_of(F.col("a")).alias("a"), address_of(F.col("b")).alias("b"))
        edges = edges.unionByName(more.where("a <> b")).distinct()
    parts = connected_components(edges)
    place = lambda df: with_rule(df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    verdicts = F.array(*(F.lit(v) for v, _, _ in rules)) if rules else F.array().cast("array<string>")
    judged = place(rows.select("id", "url"))
    own = F.try_element_at(verdicts, F.col("rule_at") + 1)
    # What each address of a component says; an address needs no page to be listed by a rule.
    said = place(parts.select("component", "node", F.concat(F.lit("x://"), F.col("node")).alias("url"))).withColumn("own", own)
    union = said.groupBy("component").agg(F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"))
    carried = cut(parts.join(union.where("allowed or blocked"), "component").select(F.col("node"), F.when(F.col("allowed"), "allow").otherwise("block").alias("alias")))
    if carried.isEmpty():
        met = judged.withColumn("alias", F.lit(None).cast("string"))
    else:
        met = judged.join(carried, address_of(F.col("url")) == F.col("node"), "left")
    names = F.array(*(F.lit(h + p) for _, h, p in rules)) if rules else F.array().cast("array<string>")
    return met.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.try_element_at(names, F.col("rule_at") + 1).alias("rule"),
        F.coalesce(own, F.col("alias"), F.lit("allow")).alias("verdict"),
        F.when(F.col("rule_at").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("via"),
    )
