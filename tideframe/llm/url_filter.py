"""URL filter: host and path rules, and link-graph propagation for what no rule settles.

Hosts are nodes; an absolute link from a page to another host is an edge. Trust is personalised PageRank from hosts
with pages that a rule allows; distrust is personalised PageRank over reversed edges from hosts with pages that a rule
blocks. A host is blocked when its distrust is over `ratio` times its trust, else allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import shared_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host in a page, also those without a scheme; group 1 is the host, with any port.
_LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
#: The host that links without one are relative to, where a page names it.
_BASE = r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
#: A link without a host.
_RELATIVE = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?!//)(?![a-z][a-z0-9+.-]*:)[^\"'\s>#]"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, every: int = 4) -> DataFrame:
    """Personalised PageRank.

    edges: src, dst, weight, one row a pair; seeds: host, mass. Returns host, rank for hosts that mass reaches. What
    a host without outgoing edges would pass on is lost, which lowers all ranks alike. Rounds end when less than
    `tolerance` of the mass is still on its way; each leaves at most `damping` of it, so they do end. Lineage is cut by
    checkpoint() every few rounds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("part")).checkpoint()
    total = seeds.agg(F.sum("mass").alias("total")).first()["total"]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    seed = seeds.select("host", (F.col("mass") / F.lit(float(total))).alias("mass")).checkpoint()
    if steps.isEmpty():
        return seed.select("host", F.col("mass").alias("rank"))
    # What arrives in a round is passed on in the next one, and what has arrived so far is the rank.
    moving = seed.select("host", (F.col("mass") * (1 - damping)).alias("rank"))
    rank, i = moving, 0
    while True:
        moving = moving.join(steps, moving["host"] == steps["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("part") * damping).alias("rank"))
        rank = rank.unionByName(moving).groupBy("host").agg(F.sum("rank").alias("rank"))
        i += 1
        if i % every == 0:
            moving, rank = moving.checkpoint(), rank.checkpoint()
            left = moving.agg(F.sum("rank").alias("left")).first()["left"]
            if left is None or left < tolerance * (1 - damping):
                return rank


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, tolerance: float = 1e-4, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns id, host, path, rule, verdict, trust and distrust (null for a host that neither reaches).

    A null url, or one without ://, has empty host and path, no rule, and the verdict allow unless links say
    otherwise. Null html has no links. Links within a host don't count. Repeated rows are judged each. An empty
    table gives an empty result; other columns are not read.
    """
    shared_dir(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", name.alias("rule"), verdict.alias("_by_rule"))

    html = F.col(html_col)
    base = F.when(html.rlike(_RELATIVE), F.slice(F.regexp_extract_all(html, F.lit(_BASE), F.lit(1)), 1, 1))
    linked = F.concat(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), F.coalesce(base, F.array().cast("array<string>")))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(linked)).alias("dst"))
    links = links.select("src", lower_ascii("dst").alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    edges = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).checkpoint()
    marks = judged.where("_by_rule is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("_by_rule") == "allow").cast("double").alias("allowed"), F.count_if(F.col("_by_rule") == "block").cast("double").alias("blocked")).checkpoint()

    trust = page_rank(edges, marks.where("allowed > 0").select("host", F.col("allowed").alias("mass")), damping, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = page_rank(back, marks.where("blocked > 0").select("host", F.col("blocked").alias("mass")), damping, tolerance)
    hosts = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust"))).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    by_links = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select(id_col, "host", "path", "rule", F.coalesce("_by_rule", by_links).alias("verdict"), "trust", "distrust")


def op5_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
