"""Block and allow rules for URLs, carried over redirects and canonical links.

Pages that redirect to each other or name each other as canonical are one component of a
link graph.  A page takes the longest rule that fits it; a page that no rule fits takes the
decision of its component, where an explicit allow comes before any block.  DataFrame
functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.llm.common import written
from factloom.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def _with_address(rows: DataFrame, url_col: str, prefix: str = "") -> DataFrame:
    """Adds host, path and node (host, path and query: the address, whatever scheme or fragment).

    Host: after the first :// up to /, ?, # or the end, A-Z lower-cased.  Path: from there up to
    ?, # or the end.  A null URL or one without :// has empty host and path and no node.
    """
    url, rest = F.col(url_col), F.col(f"{prefix}rest")
    host, path = F.col(f"{prefix}host"), F.col(f"{prefix}path")
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        rows.withColumn(f"{prefix}rest", F.coalesce(after, F.lit("")))
        .withColumns(
            {
                f"{prefix}host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
                f"{prefix}path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
                f"{prefix}query": F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1),
            }
        )
        .withColumn(
            f"{prefix}node", F.when(host != "", F.concat(host, path, F.col(f"{prefix}query")))
        )
        .drop(f"{prefix}rest", f"{prefix}query")
    )


def _resolved(target: Column, url: Column, host: Column, path: Column) -> Column:
    """An absolute URL for a link as written on a page."""
    site = F.concat(F.lit("http://"), host)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source_url, target_url) of canonical links and refresh redirects written in the pages."""
    targets = F.array(
        F.regexp_extract(F.regexp_extract(F.col("html"), _CANONICAL, 0), _HREF, 1),
        F.regexp_extract(F.regexp_extract(F.col("html"), _REFRESH, 0), _REFRESH_URL, 1),
    )
    found = (
        pages.select(F.col(url_col).alias("source_url"), F.col(html_col).alias("html"))
        .select("source_url", F.explode(targets).alias("target"))
        .where("target <> ''")
        .withColumn("target", F.replace("target", F.lit("&amp;"), F.lit("&")))
    )
    return _with_address(found, "source_url").select(
        "source_url",
        _resolved(F.col("target"), F.col("source_url"), F.col("host"), F.col("path")).alias("target_url"),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, 'host/path') pairs."""
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(
        rows, "rule_verdict string, rule string, rule_host string, rule_path string"
    )


def _rules_of(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, rule_verdict): the longest rule per node; on a tie allow, then by name.

    A host is tried under each of its suffixes, so the join is an equality on the rule's host.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = (
        nodes.select("node", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
    )
    order = F.struct(
        F.length("rule").alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), "rule"
    )
    return fits.groupBy("node").agg(F.max(order).alias("best")).select(
        "node",
        F.col("best.rule").alias("rule"),
        F.when(F.col("best.allow"), "allow").otherwise("block").alias("rule_verdict"),
    )


def judged(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of.

    `rules` comes from `rule_table`; a table of any size will do.  `redirects` may add
    (source_url, target_url) pairs to those found in the pages.  verdict is the rule's where
    one fits; else allow if any page or address of the component is explicitly allowed, block
    if one is blocked, allow if neither.  alias_of is the smallest address of the component.

    A null URL, or one without ://, has empty host and path, no aliases and the verdict allow.
    Null html has no links.  Repeated rows are judged each.  Other columns are ignored; empty
    input gives no rows.
    """
    own = _with_address(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url"
    ).drop("url")
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("source_url", "target_url"))
    links = _with_address(_with_address(links, "source_url", "source_"), "target_url")
    links = written(
        links.select("source_node", F.col("node").alias("target_node"), "host", "path").where(
            "source_node IS NOT NULL AND target_node IS NOT NULL"
        ),
        "url-links",
    )
    aliases = connected_components(links.select("source_node", "target_node"))
    nodes = own.select("node", "host", "path").unionByName(
        links.select(F.col("target_node").alias("node"), "host", "path")
    )
    nodes = nodes.where("node IS NOT NULL").distinct()
    ruled = _rules_of(nodes, rules)
    carried = (
        aliases.join(ruled, "node")
        .groupBy("component")
        .agg(
            F.max(F.col("rule_verdict") == "allow").alias("allowed"),
            F.max(F.col("rule_verdict") == "block").alias("blocked"),
        )
        .where("blocked AND NOT allowed")
        .select("component", F.lit("block").alias("carried"))
    )
    decided = (
        nodes.select("node")
        .distinct()
        .join(ruled, "node", "left")
        .join(aliases, "node", "left")
        .join(carried, "component", "left")
    )
    return own.join(decided, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "carried", F.lit("allow")).alias("verdict"),
        F.coalesce("component", "node").alias("alias_of"),
    )
