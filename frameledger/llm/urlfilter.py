"""URL filters: longest-match rules, then trust and distrust propagated over host links.

Native expressions only. Trust is a personalised PageRank from hosts with pages that a rule allows;
distrust one over the reversed edges from hosts with pages that a rule blocks. What a host receives
over links, without its own seed, decides the pages that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, remove, store, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINKS = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s<>]+)"""
DAMPING = 0.85
#: Ranks are settled when no host's grows by more than this share between two tables.
TOLERANCE = 1e-3
#: Rounds between tables that cut the lineage.
CUT = 3
#: A host is blocked if its received distrust, in blocked pages, is over this and over ``RATIO`` times its received trust,
#: in allowed pages. Neither depends on how many pages there are elsewhere.
LEAST_DISTRUST = 1e-6
RATIO = 1.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def node_of(host: Column) -> Column:
    """The host's name without user and port: the node it is in the graph of links, at either end of one."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules of each host's own name and of every domain above it."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = hosts.select("host", F.explode(suffixes).alias("rule_host"))
    found = wide.join(rules, "rule_host").select("host", F.struct(F.length(F.concat("rule_host", "path")).alias("len"), F.concat("rule_host", "path").alias("rule"), F.col("path"), F.col("verdict")).alias("r"))
    return found.groupBy("host").agg(F.collect_set("r").alias("fits"))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, w): links between the nodes of different hosts, counted."""
    links = pages.select(node_of(host_of(F.col(url_col))).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINKS), F.lit(1))).alias("dst"))
    links = links.select("src", node_of(F.translate("dst", _UPPER, _LOWER)).alias("dst"))
    return links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def received_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, least: float = LEAST_DISTRUST) -> DataFrame:
    """(host, got): personalised PageRank of ``seeds`` (host, seed) without the hosts' own seed.

    ``edges`` are (src, share, dst), the shares of a source summing to 1. Ranks start at the seeds, only grow, and
    are written to the shared folder every few rounds, until no host's grew by more than ``tolerance`` of
    itself or of ``least``. What reaches a host without links ends there. Hosts that nothing reaches are left out.
    """
    spark = edges.sparkSession
    start = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("base"))
    ranks, old, path = start.select("host", F.col("base").alias("rank")), None, None
    while True:
        for _ in range(CUT):
            sent = edges.join(ranks.withColumnRenamed("host", "src"), "src")
            got = sent.groupBy(F.col("dst").alias("host")).agg((F.lit(damping) * F.sum(F.col("rank") * F.col("share"))).alias("got"))
            ranks = start.join(got, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("rank"))
        following = fresh_path(spark, "ranks")
        got = store(got, following)
        ranks = start.join(got, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("rank"))
        settled = got.isEmpty()
        if old is not None:
            both = got.join(old.withColumnRenamed("got", "was"), "host", "left")
            settled = both.where(F.col("got") - F.coalesce("was", F.lit(0.0)) > F.lit(tolerance) * F.greatest("got", F.lit(least))).isEmpty()
            remove(spark, path)
        if settled:
            return got
        old, path = got, following


def filter_urls(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = RATIO,
    least: float = LEAST_DISTRUST,
) -> DataFrame:
    """Per page (``id_col``, host, path, rule, verdict, trust, distrust).

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Null html
    has no links. In links a host counts without its user and port. Of equally long rules the later in the alphabet wins. Repeated rows and null ids are
    judged like others, further columns are ignored, no rows give no rows.
    """
    spark = pages.sparkSession
    each = F.array(*[F.struct(F.lit(r.host).alias("rule_host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict")) for r in rules])
    given = spark.range(1).select(F.explode(each).alias("r")).select("r.*") if rules else spark.range(0).selectExpr("'' AS rule_host", "'' AS path", "'' AS verdict")
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    fits = materialize(rules_by_host(counts, given), "fits")
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])))
    ruled = parts.join(fits, "host", "left").select(id_col, "host", "path", best.alias("best"))

    edges = materialize(host_edges(pages, url_col, html_col), "edges")
    if edges.isEmpty():  # nothing can be received
        judged = ruled.withColumns({"trust": F.lit(0.0), "distrust": F.lit(0.0)})
    else:
        by_host = ruled.where("best IS NOT NULL").groupBy(node_of(F.col("host")).alias("host")).agg(F.count_if(F.col("best.verdict") == "allow").alias("good"), F.count_if(F.col("best.verdict") == "block").alias("bad"))
        by_host = materialize(by_host, "seeds")

        def seeds(column: str) -> DataFrame:
            return by_host.where(F.col(column) > 0).select("host", F.col(column).cast("double").alias("seed"))

        def shares(src: str, dst: str) -> DataFrame:
            out = edges.groupBy(F.col(src).alias("src")).agg(F.sum("w").alias("out"))
            return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "w").join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share"))

        trust = received_rank(materialize(shares("src", "dst"), "shares"), seeds("good")).withColumnRenamed("got", "trust")
        distrust = received_rank(materialize(shares("dst", "src"), "shares"), seeds("bad")).withColumnRenamed("got", "distrust")
        scores = materialize(trust.join(distrust, "host", "full"), "scores")
        judged = ruled.withColumn("node", node_of(F.col("host"))).join(scores.withColumnRenamed("host", "node"), "node", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    bad = (F.col("distrust") > least) & (F.col("distrust") > F.col("trust") * ratio)
    verdict = F.coalesce(F.col("best.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: For pages that link to no other host, as the given tables': nothing is received, so nothing else is blocked.
SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, max({'len': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS best
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id
)
SELECT p.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict, 0::DOUBLE AS trust, 0::DOUBLE AS distrust
FROM p LEFT JOIN m USING (page_id)
"""
