"""URL filters that follow redirects and canonical links: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, drop_table, materialize, spread
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for null or without ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return df.withColumns({
        "host": F.translate(F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), UPPER, LOWER),
        "path": F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")),
    })


def match_rules(df: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and explicit, the longest fitting rule and its verdict, null where none fits. A tie in length goes to allow."""
    fits = [
        F.when(
            ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(v == "allow").alias("a"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    best = F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<n:int,a:boolean,rule:string,verdict:string>")
    return df.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "explicit": F.col("_best.verdict")}).drop("_best")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b): a page's url, and the absolute url of its canonical link or meta refresh. Relative targets are resolved against the page's url."""
    tags = pages.where(F.col(url).isNotNull() & F.rlike(html, F.lit(r"(?i)\bcanonical\b|http-equiv"))).select(
        F.col(url).alias("a"), F.explode(F.regexp_extract_all(html, F.lit(TAG), F.lit(0))).alias("tag")
    )
    to = F.when(F.rlike("tag", F.lit(r"(?is)\brel\s*=\s*[\"']?canonical\b")), F.regexp_extract("tag", HREF, 1)).when(
        F.rlike("tag", F.lit(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b")), F.regexp_extract("tag", REFRESH, 1)
    )
    to = F.replace(to, F.lit("&amp;"), F.lit("&"))
    part = lambda pattern: F.regexp_extract("a", pattern, 1)
    page, origin = part(r"(?s)^(.*?://[^?#]*)"), part(r"(?s)^(.*?://[^/?#]*)")
    folder = F.coalesce(F.nullif(part(r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)"), F.lit("")), F.concat(origin, F.lit("/")))
    to = (
        F.when(F.rlike(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | (to == ""), to)
        .when(F.startswith(to, F.lit("//")), F.concat(part(r"(?s)^(.*?:)//"), to))
        .when(F.startswith(to, F.lit("/")), _without_dots(F.concat(origin, to)))
        .when(F.startswith(to, F.lit("?")) | F.startswith(to, F.lit("#")), F.concat(page, to))
        .otherwise(_without_dots(F.concat(folder, to)))
    )
    return tags.select("a", to.alias("b")).where("b LIKE '%://%' AND a != b").distinct()


def _without_dots(url: Column) -> Column:
    """The url with the segments . and .. of its path resolved."""
    part = lambda n: F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)/?([^?#]*)(.*)$", n)
    steps = F.split(F.regexp_replace(part(2), r"(^|/)(\.\.?)$", "$1$2/"), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(steps, none, lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    return F.concat(part(1), F.lit("/"), F.array_join(kept, "/"), part(3))


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, host, path, rule, verdict, component) for every row of pages.

    Redirects (rows a, b of urls, if any) and the pages' own canonical links and refreshes are edges of a
    graph of urls. Every url of it is matched against the rules; in a connected component an explicit
    allow comes first, then a block, and urls without a rule of their own take that verdict; the
    rule of a url always holds for itself. Urls outside any component, null and broken ones are allowed,
    as are all if there are no rules. Repeated rows are judged alike; null keys are kept; other
    columns are ignored.
    """
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    edges = alias_edges(own, "_url", "_html")
    if redirects is not None:
        edges = edges.unionByName(redirects.select("a", "b").where("a != b"))
    members = connected_components(materialize(edges, "links"))
    judged = materialize(match_rules(split_url(members, "node"), rules).select("node", "component", "explicit"), "judged")
    sums = {f"_{v}": ("sum", (F.col("explicit") == v).cast("long")) for v in ("allow", "block")}
    decided = spread(judged, ["component"], sums, ["node"], "_block > 0 AND coalesce(_allow, 0) = 0")
    verdicts = materialize(decided.select(F.col("node").alias("_url"), "component"), "blocked")
    drop_table(judged)
    rows = match_rules(split_url(own.select("_key", "_url"), "_url"), rules)
    if not verdicts.isEmpty():  # each verdict goes to SALTS tasks, so that a url of many pages is no hot key
        copies = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(copies, ["_url", "_salt"], "left").drop("_salt")
    else:
        rows = rows.withColumn("component", F.lit(None).cast("string"))
    verdict = F.coalesce("explicit", F.when(F.col("component").isNotNull(), "block"), F.lit("allow"))
    return rows.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "component")
