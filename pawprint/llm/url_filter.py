"""URL filter: rules, and for pages without a rule the trust and distrust that links carry between hosts (DataFrame operations only).

1. A rule (action, host, path) fits the urls of its host and all subdomains whose path starts with its path; the
   longest one decides. Distinct pairs of host and path are joined to the rules by each suffix of the host.
2. Links (href of a elements) are resolved to hosts and counted for each pair of hosts; relative ones lead to the
   page's own host and count like others, so that a host that mostly links to itself keeps its mass.
3. A host's trust starts from the share of its pages that a rule allows, its distrust from the share that one blocks.
   Trust goes along links, distrust against them, each divided by a host's links out (in), with damping: personalised
   PageRank of both kinds in one loop of joins and sums over tables. It ends when no host changes by more than
   tolerance, or after most_steps steps.
4. A page without a rule is blocked if distrust is more than cut of its host's trust and distrust together, otherwise
   allowed, also where both are nothing.

Masses, hosts and rules are broadcast only if their counted size is under common.BROADCAST_BYTES; otherwise shuffles
join them, and adaptive execution splits a host with very many pages or links. Pages of one host are never gathered.

Defined cases: a url that is null or has no "://" has an empty host and path, and no rule; its links count for no
host, and it is allowed; a null html has no links; repeated pages count each; rows are passed through, with a null
page_id too; an empty table gives an empty result; without rules all are allowed; of equally long rules the
first in order of action goes; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_broadcast, temporary, written

#: Host and path of a url, links of a page (inside of a tag, nothing is read beyond its end), and schemes.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)<a[\x09-\x0D\x20][^<>]*?href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*("[^"]*"|'[^']*'|[^\x09-\x0D\x20<>"']+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Memory of a row with a host in a broadcast join.
HOST_BYTES = 400


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """action, rule_host, rule_path, rule of a few rules as a table; a longer list comes as such a table itself."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("action", "rule_host", "rule_path"), r, strict=True)]) for r in rules])
    table = spark.range(1).select(F.inline(rows)) if rules else spark.range(0).select(*[F.lit("").alias(n) for n in ("action", "rule_host", "rule_path")])
    return table.select("*", F.concat("rule_host", "rule_path").alias("rule"))


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """for_host, for_path, rule, action of the distinct pairs that a rule fits."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = pages.select("host", "path").distinct().filter("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = asked.join(bounded_broadcast(rules, rules.count(), HOST_BYTES), (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    best = F.min(F.struct((-F.length("rule")).alias("size"), "action", "rule"))
    return fits.groupBy(F.col("host").alias("for_host"), F.col("path").alias("for_path")).agg(best.alias("best")).select("for_host", "for_path", "best.rule", "best.action")


def link_host(link: Column, own: Column) -> Column:
    """The host that a link leads to; null for other schemes than those with //, and for a place within the page."""
    bare = F.regexp_replace(link, r"""^["']|["']$""", "")
    bare = F.regexp_replace(bare, r"^[\x09-\x0D\x20]+", "")
    with_scheme = F.when(bare.startswith("//"), F.concat(F.lit(":"), bare)).otherwise(bare)
    full = with_scheme.startswith("://") | with_scheme.rlike(SCHEME + "//")
    return F.when(full, F.nullif(host_of(with_scheme), F.lit(""))).when(bare.rlike(SCHEME) | bare.startswith("#"), F.lit(None)).otherwise(own)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts, of pages with host and html."""
    to = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda link: link_host(link, F.col("host")))
    each = pages.filter("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(to).alias("dst"))
    return each.filter("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most_steps: int = 50) -> DataFrame:
    """kind, host, mass: seeds (kind, host, mass) spread over links (src, dst, n); trust along them, distrust against them."""
    out = links.groupBy(F.col("src").alias("out_of")).agg(F.sum("n").alias("total"))
    into = links.groupBy(F.col("dst").alias("into")).agg(F.sum("n").alias("total"))
    share = (F.col("n") / F.col("total") * damping).alias("share")
    along = links.join(bounded_broadcast(out, out.count(), HOST_BYTES), F.col("src") == F.col("out_of")).select(F.lit("trust").alias("by"), F.col("src").alias("giver"), F.col("dst").alias("host"), share)
    against = links.join(bounded_broadcast(into, into.count(), HOST_BYTES), F.col("dst") == F.col("into")).select(F.lit("distrust").alias("by"), F.col("dst").alias("giver"), F.col("src").alias("host"), share)
    edges = written(along.unionByName(against), "host-edges")
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    now = written(seeds, "masses")
    for _ in range(most_steps):
        given = bounded_broadcast(now.withColumnRenamed("host", "from_host"), now.count(), HOST_BYTES)
        moved = edges.join(given, (F.col("by") == F.col("kind")) & (F.col("giver") == F.col("from_host"))).select("kind", "host", (F.col("mass") * F.col("share")).alias("mass"))
        then = written(start.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "masses")
        apart = then.unionByName(now.withColumn("mass", -F.col("mass"))).groupBy("kind", "host").agg(F.abs(F.sum("mass")).alias("apart"))
        change = apart.agg(F.max("apart")).first()[0] or 0.0
        now = then
        if change <= tolerance:
            break
    return now


def judged(pages: DataFrame, rules: DataFrame, cut: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **steps) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host) for each row of pages."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    with temporary(spark):
        ruled = written(by_rules(rows, rules), "ruled")
        found = bounded_broadcast(ruled, ruled.count(), 2 * HOST_BYTES)
        placed = rows.select("page_id", "host", "path").join(found, (F.col("host") == F.col("for_host")) & (F.col("path") == F.col("for_path")), "left")
        placed = written(placed.select("page_id", "host", "path", "rule", "action"), "pages-ruled")
        shares = placed.filter("host <> ''").groupBy("host").agg(*[(F.count_if(F.col("action") == a) / F.count(F.lit(1))).alias(k) for a, k in (("allow", "trust"), ("block", "distrust"))])
        seeds = shares.unpivot(["host"], ["trust", "distrust"], "kind", "mass").filter("mass > 0")
        masses = spread(written(seeds, "seeds"), written(host_links(rows), "host-links"), **steps)
        hosts = masses.groupBy(F.col("host").alias("of_host")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
        hosts = written(hosts, "host-verdicts")
        out = placed.join(bounded_broadcast(hosts, hosts.count(), HOST_BYTES), F.col("host") == F.col("of_host"), "left")
        trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust"))
        # rounded, so that masses added up in another order are judged alike
        bad = F.coalesce(F.round(F.try_divide(distrust, trust + distrust), 6) > cut, F.lit(False))
        verdict = F.coalesce("action", F.when(bad, "block").otherwise("allow"))
        return written(out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")), "judged", keep=True)
