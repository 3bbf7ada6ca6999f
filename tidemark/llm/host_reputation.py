"""URL filter by empirical-Bayes host reputation, DataFrame functions only.

Labelled page outcomes are counted by host. Each host's bad rate has a beta prior whose mean is its registered domain's
posterior mean, that one's prior mean is its suffix's, and that one's the overall rate; the strength of the priors at each
level is the beta-binomial moment estimate of how much siblings differ. The registered domain is taken to be the last two labels
of the host (no list of public suffixes: hosts under co.uk share one domain). A host is blocked where the lower bound of its
posterior bad rate exceeds `max_bad`; the bound is the normal approximation to the beta posterior's quantile, z deviations below
its mean. Ports and user names are part of the host, as in the contract. Rules of the form host/path-prefix override the method; the longest one wins.

Null urls and urls without `://`: host and path are empty, judged as one host. Hosts without outcomes have their prior.
Repeated pages are each judged; null outcomes are left out; an empty table gives an empty result. Other columns of pages
pass through; columns named like the operator's own (host, path, rule, verdict, n_labelled, n_bad, bad_bound) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: The rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; the rule list is part of the plan, so keep it to hundreds."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, prefix = text.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent: list[str], least: float = 2.0, most: float = 10_000.0) -> float:
    """Pooled moment estimate of a beta prior's strength among children (n, k) of each parent; one row reaches the driver."""
    group = children.filter("n > 0").groupBy(*parent).agg(F.sum("n").alias("N"), F.sum("k").alias("K"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kkn"), F.count("*").alias("c"))
    p = F.col("K") / F.col("N")
    group = group.filter((F.col("c") > 1) & (F.col("K") > 0) & (F.col("K") < F.col("N")))
    chi = (F.col("kkn") - p * p * F.col("N")) / (p * (1 - p))
    row = group.agg(F.sum(chi).alias("chi"), F.sum(F.col("c") - 1).alias("df"), F.sum(F.col("N") - F.col("nn") / F.col("N")).alias("spread")).first()
    if not row or not row["df"]:
        return most
    mean_n = row["spread"] / row["df"]
    rho = (row["chi"] / row["df"] - 1) / max(mean_n - 1, 1e-9)
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, k) -> also bad_bound, the lower bound of the host's posterior bad rate."""
    labels = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    hosts = materialize(hosts)
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    by_host, by_domain, by_suffix = _strength(hosts, ["domain"]), _strength(domains, ["suffix"]), _strength(suffixes, [])

    def posterior(prior: Column, m: float) -> Column:
        return (m * prior + F.col("k")) / (m + F.col("n"))

    suffixes = suffixes.select("suffix", posterior(F.lit(overall), by_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", posterior(F.col("suffix_rate"), by_domain).alias("domain_rate"))
    out = hosts.join(domains, "domain")
    mean, size = posterior(F.col("domain_rate"), by_host), by_host + F.col("n")
    return out.select("host", "n", "k", (mean - z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, max_bad: float = 0.3, z: float = 1.645) -> DataFrame:
    """pages plus host, path, rule, verdict, n_labelled, n_bad and bad_bound; outcomes: (key, bad 0/1), one row a page."""
    host, path = url_parts(F.col(url))
    own = ["host", "path", "rule", "verdict", "n_labelled", "n_bad", "bad_bound"]
    parts = pages.select(*[c for c in pages.columns if c not in own or c in (key, url)], host.alias("host"), path.alias("path"))
    seen = outcomes.filter(F.col("bad").isNotNull()).groupBy(key).agg(F.max("bad").alias("bad"))
    counted = parts.select(key, "host").join(seen, key).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = parts.groupBy("host").agg(F.count("*").alias("_pages")).drop("_pages").join(counted, "host", "left").fillna(0, ["n", "k"])
    judged = reputation(hosts, z).select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "bad_bound")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return parts.join(judged, "host").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_method))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of a page: its document's quality label; the document's number stands in the url after the language."""
    _, path = url_parts(F.col("url"))
    numbered = pages.select("page_id", F.regexp_extract(path, "^/[a-z]+/([0-9]+)", 1).alias("d")).filter("d <> ''").select("page_id", F.col("d").try_cast("long").alias("doc_id"))
    bad = labels.filter("quality is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    return numbered.join(bad, "doc_id").select("page_id", "bad")


def op7_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = filter_urls(pages, page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


def _rule_sql() -> str:
    fits = lambda t: f"(host = '{t.split('/')[0]}' OR host LIKE '%.{t.split('/')[0]}') AND starts_with(path, '/{t.split('/', 1)[1]}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    return "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered) + " END AS rule, CASE " + " ".join(f"WHEN {fits(t)} THEN '{w}'" for w, t in ordered) + " END AS ruled"


OP7_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, {_rule_sql()}, regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS d FROM u),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, try_cast(d AS BIGINT) AS doc_id FROM p) JOIN l USING (doc_id) GROUP BY page_id),
h AS (SELECT host, count(bad)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS k, string_split(host, '.')[-1] AS suffix,
        array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM p LEFT JOIN o USING (page_id) GROUP BY host),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
sx AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS rate FROM sx),
levels AS (SELECT 'h' AS lv, domain AS parent, n, k FROM h UNION ALL SELECT 'd', suffix, n, k FROM dm UNION ALL SELECT 's', '', n, k FROM sx),
q AS (SELECT lv, parent, sum(n)::DOUBLE AS N0, sum(k)::DOUBLE AS K0, sum(n * n)::DOUBLE AS nn, sum(k::DOUBLE * k / n) AS kkn, count(*) AS c FROM levels WHERE n > 0 GROUP BY ALL),
x AS (SELECT lv, sum((kkn - (K0 / N0) * (K0 / N0) * N0) / ((K0 / N0) * (1 - K0 / N0))) / sum(c - 1) AS ratio, sum(N0 - nn / N0) / sum(c - 1) AS mean_n FROM q WHERE c > 1 AND K0 > 0 AND K0 < N0 GROUP BY lv),
m AS (SELECT lv, CASE WHEN ratio > 1 THEN least(10000.0, greatest(2.0, greatest(mean_n - 1, 1e-9) / (ratio - 1) - 1)) ELSE 10000.0 END::DOUBLE AS m FROM x),
s1 AS (SELECT suffix, (ms * rate + k) / (ms + n) AS rate FROM sx, (SELECT coalesce((SELECT m FROM m WHERE lv = 's'), 10000.0)::DOUBLE AS ms), g),
d1 AS (SELECT domain, (md * s1.rate + k) / (md + n) AS rate FROM dm JOIN s1 USING (suffix), (SELECT coalesce((SELECT m FROM m WHERE lv = 'd'), 10000.0)::DOUBLE AS md)),
h1 AS (SELECT host, n, k, (mh * d1.rate + k) / (mh + n) AS mean, mh + n AS size FROM h JOIN d1 USING (domain), (SELECT coalesce((SELECT m FROM m WHERE lv = 'h'), 10000.0)::DOUBLE AS mh))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled, k AS n_bad
FROM p JOIN h1 USING (host)
"""
