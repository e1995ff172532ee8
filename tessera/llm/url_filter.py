"""URL filters: rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled outcomes of pages are counted per host; the share of bad pages is shrunk through beta-binomial priors from the
host to its registered domain to its public suffix to all pages. The weight of each prior is estimated from the data by
moments. A host is blocked if the lower posterior bound of its bad share exceeds `MOST_BAD`.

Counts are aggregated by host before any join, so a hot host is one row; the join back to pages is an equi-join whose
skewed partitions Spark can split (or whose host side it broadcasts if its measured size allows).

Edge cases: a null url, or one without `://`, has an empty host and path and is judged like a host of its own; an
unlabelled host gets its domain's mean; user and port stay in the host and don't count for its domain; urls of any length
are read whole; repeated outcomes of a page count once (bad wins); null outcomes count as
unlabelled; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored

#: (verdict, host, path), as the contract fixes them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Public suffixes of two labels, unless the caller gives a list; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx")
MOST_BAD = 0.2
#: One-sided normal quantile of the bound.
Z = 1.2816
#: Bounds of a prior's weight, in pages.
WEIGHT = (2.0, 1000.0)

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host) -> F.Column:
    """The host without user and port, as domain and suffix are taken from it."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host, suffixes=TWO_LABEL_SUFFIXES) -> F.Column:
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(bare_host(host), ".", -1))


def domain_of(host, suffixes=TWO_LABEL_SUFFIXES) -> F.Column:
    two = F.substring_index(bare_host(host), ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(bare_host(host), ".", -3)).otherwise(two)


def ruled(rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule = verdict = None
    for v, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def _level(groups: DataFrame, prior: F.Column) -> DataFrame:
    """Adds `mean`, the posterior mean of each group given `prior`, whose weight is fitted over the groups."""
    g = groups.withColumn("prior", prior)
    noise = F.col("prior") * (1 - F.col("prior"))
    fit = g.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("prior"), 2)).alias("spread"),
        F.sum(noise).alias("noise"),
        F.sum("n").alias("total"),
        (F.sum(noise * F.col("n")) / F.sum("n")).alias("mean_noise"),
    ).first()  # one row of sums
    weight = WEIGHT[1]
    if fit["total"] and (between := (fit["spread"] - fit["noise"]) / fit["total"]) > 0:
        weight = max(WEIGHT[0], min(WEIGHT[1], fit["mean_noise"] / between - 1))
    return g.withColumn("weight", F.lit(float(weight))).withColumn("mean", (F.col("y") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))


def reputation(hosts: DataFrame, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n, y -> host, mean, bound."""
    hosts = Stored(hosts.select("host", "n", "y", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")), "hosts").df
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    whole = suffixes.agg(F.coalesce((F.sum("y") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("all_mean")).first()["all_mean"]
    suffixes = _level(suffixes, F.lit(float(whole))).select("suffix", F.col("mean").alias("suffix_mean"))
    domains = _level(domains.join(suffixes, "suffix"), F.col("suffix_mean")).select("domain", "suffix", F.col("mean").alias("domain_mean"))
    out = _level(hosts.join(domains, ["domain", "suffix"]), F.col("domain_mean"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return out.select("host", "mean", (F.col("mean") - Z * spread).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, bad 0/1), two-label public suffixes -> page_id, host, path, rule, verdict, bad_bound."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    seen = p.select("page_id", "host").join(known, "page_id")
    labelled = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("y"))
    hosts = (
        p.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("y"))
        .unionByName(labelled).groupBy("host").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    )
    rule, verdict = ruled()
    own = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return p.join(reputation(hosts, suffixes), "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bound", 6).alias("bad_bound"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of the document with its number has quality 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad")))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules)) + f" WHEN bound > {MOST_BAD} THEN 'block' ELSE 'allow' END"
    last = lambda k: f"array_to_string(list_slice(string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), -{k}, -1), '.')"
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def level(name: str, rows: str, prior: str) -> str:
        return f"""{name}_in AS ({rows}),
{name}_fit AS (SELECT sum(n * pow(y / n - {prior}, 2)) AS spread, sum({prior} * (1 - {prior})) AS noise, sum(n) AS total,
    sum({prior} * (1 - {prior}) * n) / sum(n) AS noise_mean FROM {name}_in WHERE n > 0),
{name}_weight AS (SELECT CASE WHEN (spread - noise) / total > 0
    THEN greatest({WEIGHT[0]}, least({WEIGHT[1]}, noise_mean / ((spread - noise) / total) - 1)) ELSE {WEIGHT[1]} END AS weight FROM {name}_fit),
{name}_out AS (SELECT g.*, weight, (y + weight * {prior}) / (n + weight) AS mean FROM {name}_in g, {name}_weight)"""

    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(CAST(quality = 0 AS BIGINT)) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, {last(2)} IN ({two}) AS long_suffix, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS y
    FROM p LEFT JOIN known USING (page_id) GROUP BY host),
named AS (SELECT host, n, y, CASE WHEN long_suffix THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN long_suffix THEN {last(2)} ELSE {last(1)} END AS suffix FROM hosts),
whole AS (SELECT coalesce((sum(y) + 1) / (sum(n) + 2), 0.5) AS all_mean FROM named),
{level("suffixes", "SELECT suffix, sum(n) AS n, sum(y) AS y, any_value(all_mean) AS all_mean FROM named, whole GROUP BY suffix", "all_mean")},
{level("domains", "SELECT domain, n.suffix, sum(n.n) AS n, sum(n.y) AS y, any_value(s.mean) AS suffix_mean FROM named n JOIN suffixes_out s USING (suffix) GROUP BY domain, n.suffix", "suffix_mean")},
{level("hosted", "SELECT n.host, n.n, n.y, d.mean AS domain_mean FROM named n JOIN domains_out d ON n.domain = d.domain AND n.suffix = d.suffix", "domain_mean")},
rated AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + weight + 1)) AS bound FROM hosted_out)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, round(bound, 6) AS bad_bound FROM p JOIN rated USING (host)
"""


ORACLE_SQL = _sql()
