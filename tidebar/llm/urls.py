"""URL filters: rules by host and path, and personalised PageRank of trust and distrust over the graph of hosts.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule decides. Hosts of
urls without a rule are judged by propagation from seeds: the share of a host's pages that rules allow or block.

Distrust goes from blocked seeds against the links, trust from trusted seeds along them. Both are personalised PageRank from
the receiving host's end: distrust is the chance that a walk from the host along its links, which at each host stops there with
the chance of its seed and else goes on with DAMPING, ends in a blocked host; trust is the chance that the same walk against the
links ends in a trusted one. So a value never falls below a host's own seed and doesn't shrink with the number of hosts that
link to a blocked one, as mass that is split among them would; one threshold holds for every degree. A page without links to other
hosts ends a walk along links where it is, in nothing, so that one link among many pages that link nowhere weighs little. Hosts are blocked at a
distrust of at least THRESHOLD that also exceeds their trust.

Links come from absolute href attributes in the html; links inside a host move nothing and are left out. Propagation is
joins and sums in Spark, written to the shared folder after each step, until no value moves by more than EPSILON. Values only
grow, by a factor of at most DAMPING from step to step, so what is left then is at most EPSILON * DAMPING / (1 - DAMPING). Hot
hosts (many pages, links or linkers): sums are partial before shuffles, and adaptive execution splits the joins.

Nulls and odd rows: a null url or one without :// has empty host and path, fits no rule and is allowed; null html has no links.
Null ids, ties and repeated rows are judged one by one (each counts as a page of its host). Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import cut, forget, settled, table

# The rules and their verdicts.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
DAMPING = 0.85
EPSILON = 1e-5
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def linked_hosts(html: Column) -> Column:
    """The hosts of all absolute links of a page."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))
    return F.transform(found, lambda x: F.translate(x, _UPPER, _LOWER))


def propagate(seeds: DataFrame, links: DataFrame, ends: DataFrame | None = None, damping: float = DAMPING, epsilon: float = EPSILON) -> DataFrame:
    """host, trust and distrust of all hosts of seeds (host, trusted, blocked) and links (src, dst, weight); ends (host, weight) are the
    places of a host where a walk along links finds none and ends."""
    # Value flows from b to a, in shares of a's links: out-links for distrust, in-links for trust.
    ways = links.select(F.lit(False).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(links.select(F.lit(True).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    out_of = ways.select("kind", "a", "weight")
    if ends is not None:
        out_of = out_of.unionByName(ends.select(F.lit(False).alias("kind"), F.col("host").alias("a"), "weight"))
    total = out_of.groupBy(F.col("kind").alias("k"), F.col("a").alias("s")).agg(F.sum("weight").alias("total"))
    ways = cut(ways.join(total, (F.col("kind") == F.col("k")) & (F.col("a") == F.col("s"))).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share")), "ways")
    hosts = seeds.select("host", "trusted", "blocked").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked")))
    hosts = hosts.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked"))
    start = hosts.select("host", F.explode(F.array(F.struct(F.lit(True).alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit(False).alias("kind"), F.col("blocked").alias("seed")))).alias("x")).select("host", "x.*")
    now = cut(start.withColumn("value", F.col("seed")).withColumn("moved", F.col("seed")), "trust")
    while ways.limit(1).count() and now.where(F.col("moved") > epsilon).limit(1).count():
        out = now.where("value > 0").select(F.col("kind").alias("k"), F.col("host").alias("h"), "value")
        told = ways.join(out, (F.col("kind") == F.col("k")) & (F.col("b") == F.col("h"))).groupBy(F.col("kind").alias("k"), F.col("a").alias("h")).agg(F.sum(F.col("value") * F.col("share")).alias("told"))
        value = F.col("seed") + (1 - F.col("seed")) * F.lit(damping) * F.coalesce("told", F.lit(0.0))
        after = now.join(told, (F.col("host") == F.col("h")) & (F.col("kind") == F.col("k")), "left")
        before, now = now, cut(after.select("host", "kind", "seed", value.alias("value"), F.abs(value - F.col("value")).alias("moved")), "trust")
        forget(before)
    return now.groupBy("host").agg(F.max(F.when(F.col("kind"), F.col("value"))).alias("trust"), F.max(F.when(~F.col("kind"), F.col("value"))).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # Everything that is needed of a page, so that its html is read once.
    found = cut(read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), linked_hosts(F.col("html")).alias("to")), "pages")
    seeds = found.where("host != ''").groupBy("host").agg(F.avg(F.expr("if(by_rule <=> 'allow', 1.0D, 0.0D)")).alias("trusted"), F.avg(F.expr("if(by_rule <=> 'block', 1.0D, 0.0D)")).alias("blocked"))
    ends = found.where("host != '' and not exists(to, x -> x != '' and x != host)").groupBy("host").agg(F.count(F.lit(1)).alias("weight"))
    links = found.where("host != ''").select(F.col("host").alias("src"), F.explode("to").alias("dst")).where("dst != '' and src != dst")
    links = cut(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")), "links")
    hosts = settled(lambda: propagate(seeds, links, ends, **options).withColumnRenamed("host", "__h"), "hosts")
    out = found.select("page_id", "host", "path", "rule", "by_rule").join(hosts, F.col("host") == F.col("__h"), "left")
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")


def op1_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
