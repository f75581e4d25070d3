"""URL filters: explicit rules first, then an empirical-Bayes reputation of hosts; DataFrame functions throughout.

Pages with a known outcome are counted per host and rolled up to registered domains and suffixes. Each level's bad rate is
shrunk toward the level above by a beta prior whose strength is fitted by moments, and a host is blocked when the lower
posterior bound of its rate passes the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.session import cut_lineage

# The rules of the contract, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LIMIT, DEVIATIONS = 0.5, 2.0
WEAKEST, STRONGEST = 1.0, 1000.0
MARK_SHARE = 0.02


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for NULL."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, NULL where none does; rules are part of the plan, so keep them few."""
    chain = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain


def page_outcome(html: Column) -> Column:
    """1 where the page's text outside tags is full of marks, shouting included, 0 where it is not, NULL where there is no text."""
    text = F.trim(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*+>|&\w+;", " "))

    def judge(t: Column) -> Column:
        marks = F.length(F.regexp_replace(t, r"[^#*$%&|!]+", ""))
        return F.when(F.length(t) > 0, (marks > MARK_SHARE * F.length(t)).cast("int"))

    # Bound by a lambda, so that a page is stripped once although its text is asked for several times.
    return F.element_at(F.transform(F.array(text), judge), 1)


def _strength(groups: DataFrame, mean: float) -> float:
    """Beta strength by moments: how much more the groups' rates vary than binomial noise around ``mean`` would make them."""
    rate = F.col("bad") / F.col("n")
    row = groups.where("n > 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * (rate - mean) ** 2).alias("v"),
                                    F.sum(F.col("n") * F.col("n")).alias("square")).first()
    if not row.g or row.g < 2 or not 0 < mean < 1:
        return STRONGEST
    noise, spread = mean * (1 - mean), row.n - row.square / row.n
    between = max(0.0, (row.v - (row.g - 1) * noise) / spread) if spread > 0 else 0.0
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, noise / between - 1))


def host_verdicts(counts: DataFrame, *, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """host, posterior mean and bound, and whether it is blocked, from (host, n, bad) with one row per host."""
    label = F.split("host", r"\.")
    hosts = counts.withColumn("suffix", F.element_at(label, -1)).withColumn(
        "domain", F.when(F.size(label) > 1, F.concat_ws(".", F.element_at(label, -2), F.element_at(label, -1))).otherwise(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = total.bad / total.n if total.n else 0.0
    s_suffix, s_domain, s_host = (_strength(g, mean) for g in (suffixes, domains, hosts))
    suffix_rate = suffixes.select("suffix", ((F.col("bad") + s_suffix * mean) / (F.col("n") + s_suffix)).alias("above"))
    domain_rate = domains.join(suffix_rate, "suffix").select("domain", ((F.col("bad") + s_domain * F.col("above")) / (F.col("n") + s_domain)).alias("prior"))
    a = F.col("bad") + s_host * F.col("prior")
    b = F.col("n") - F.col("bad") + s_host * (1 - F.col("prior"))
    rated = hosts.join(domain_rate, "domain").select("host", (a / (a + b)).alias("rate"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"))
    bound = F.greatest(F.lit(0.0), F.col("rate") - deviations * F.col("sd"))
    return rated.select("host", F.col("rate").alias("bad_rate"), bound.alias("bad_bound"), (bound > limit).alias("blocked"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, outcome: Column | None = None, *, limit: float = LIMIT,
               deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict and bad_bound for every row of ``pages`` (page_id, url, html).

    The longest fitting rule decides; where none fits the host's posterior does. ``outcome`` is any 0/1/NULL column of pages,
    by default ``page_outcome`` of the html. Pages without an outcome are judged but not counted, a host without a counted
    page has its prior; NULL urls and urls without ``://`` have the empty host and path, which is judged like any host. Repeated
    rows count as often as they occur. The html is read once, into a written table of one row per host; a host with very many
    pages is one row after the combine, and Spark splits the closing join for it.
    """
    outcome = page_outcome(F.col("html")) if outcome is None else outcome
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), outcome.alias("outcome"))
    counts = parsed.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    verdicts = host_verdicts(cut_lineage(counts, "hosts"), limit=limit, deviations=deviations)
    ruled = parsed.drop("outcome").withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.join(verdicts, "host").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "bad_bound")
