"""URL filter by Empirical-Bayes host reputation, with explicit rules on top.

Labelled page outcomes are shrunk through beta-binomial priors from host to registered domain to
public suffix to the whole table. The strength of each prior is estimated from the data by
moments. A host is blocked when a lower bound of its posterior share of bad pages is above a
limit; hosts with few labels follow their domain, unknown domains their suffix.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Rules of the query, (action, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Public suffixes of two labels; callers with a full list pass their own.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.nz", "co.id", "or.id", "go.id", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za")
# Words that make a page's outcome bad when they stand in its url; callers with labels of their own use those.
BAD_WORDS = ("ads", "adult", "bets", "betting", "casino", "pills", "porn", "spam", "viagra", "xxx")
MAX_BAD, Z, MIN_STRENGTH, MAX_STRENGTH = 0.3, 1.645, 1.0, 10_000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url) -> Column:
    """Host with A-Z lower-cased; empty for null or a url without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url) -> Column:
    """Path up to ``?``, ``#`` or the end; empty for null or a url without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def bad_url(words=BAD_WORDS) -> str:
    """Pattern of a lower-case url part that has one of the words between other signs than letters."""
    return f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)"


def page_outcomes(pages: DataFrame, words=BAD_WORDS) -> DataFrame:
    """``page_id, bad``: one outcome per page, bad if host or path has one of the words.

    A word in the path makes one page bad; a host is blocked for it only if most of its pages, or of
    its domain's, are. A null url is not bad.
    """
    part = F.concat(url_host("url"), F.translate(url_path("url"), _UPPER, _LOWER))
    return pages.select("page_id", F.rlike(part, F.lit(bad_url(words))).cast("int").alias("bad"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """``page_id, bad``: one outcome per label row, bad if of quality 0 or toxic; a label belongs to the page of its number."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and action of the longest rule that fits, both null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def with_domain(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Adds ``domain`` (suffix and one label) and ``suffix``. Addresses and single names are
    their own domain without suffix; user names and ports do not count."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$|\.+$", "")
    parts = F.split("bare", r"\.")
    address = F.col("bare").rlike(r"^[0-9.]*$|^\[") | (F.size("parts") < 2)
    two = F.array_join(F.slice("parts", -2, 2), ".").isin(*suffixes) & (F.size("parts") > 2)
    suffix = F.when(two, F.array_join(F.slice("parts", -2, 2), ".")).otherwise(F.element_at("parts", -1))
    domain = F.array_join(F.slice("parts", F.when(two, F.lit(-3)).otherwise(F.lit(-2)), F.lit(3)), ".")
    return (
        hosts.withColumn("bare", bare)
        .withColumn("parts", parts)
        .withColumn("suffix", F.when(address, "").otherwise(suffix))
        .withColumn("domain", F.when(address, F.col("bare")).otherwise(domain))
        .drop("bare", "parts")
    )


def strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the beta prior's strength over groups with ``n`` outcomes, ``bad`` of them bad,
    by the moment estimate of the correlation within groups; never more than the outcomes there are."""
    n, p = F.col("n").cast("double"), F.col("bad") / F.col("n")
    s = groups.where("n > 0").agg(
        F.count("n").alias("k"), F.sum(n).alias("t"), F.sum(n * n).alias("q"), F.sum("bad").cast("double").alias("b"),
        F.sum(n * p * p).alias("v"),
    )
    mean = F.try_divide(F.col("b"), F.col("t"))
    spread = F.try_divide(F.col("v") - F.col("t") * mean * mean, mean * (1 - mean)) - (F.col("k") - 1)
    rho = F.try_divide(spread, F.col("t") - F.try_divide(F.col("q"), F.col("t")) - (F.col("k") - 1))
    m = F.when(rho > 0, F.try_divide(F.lit(1.0), rho) - 1).otherwise(MAX_STRENGTH)
    return s.select(
        F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), F.coalesce(m, F.lit(MAX_STRENGTH)), F.coalesce("t", F.lit(0.0)))).alias(name),
        ((F.coalesce("b", F.lit(0.0)) + 0.5) / (F.coalesce("t", F.lit(0.0)) + 1)).alias(f"{name}_mean"),
    )


def host_reputation(hosts: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """From one row per ``host`` with ``n`` labelled pages and ``bad`` bad ones: the posterior's
    ``rate``, its lower ``bound`` and ``judged`` (block or allow)."""
    hosts = with_domain(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def shrunk(mean: str, m: str) -> Column:
        return (F.col("bad") + F.col(m) * F.col(mean)) / (F.col("n") + F.col(m))

    # each strength() is a single row, so these joins only add constants
    suffixes = suffixes.join(F.broadcast(strength(suffixes, "ms")), F.lit(True)).select("suffix", shrunk("ms_mean", "ms").alias("suffix_rate"))
    domains = domains.join(F.broadcast(strength(domains, "md")), F.lit(True)).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", shrunk("suffix_rate", "md").alias("domain_rate"))
    a = F.col("bad") + F.col("mh") * F.col("domain_rate")
    total = F.col("n") + F.col("mh")
    rate = a / total
    bound = F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (total + 1)))
    return (
        hosts.join(F.broadcast(strength(hosts, "mh")), F.lit(True))
        .join(domains, ["domain", "suffix"])
        .select("host", "domain", "n", F.round(rate, 6).alias("rate"), F.round(bound, 6).alias("bound"))
        .withColumn("judged", F.when(F.col("bound") > max_bad, "block").otherwise("allow"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, labelled, bad_rate, bad_bound``.

    ``pages`` has ``page_id`` and ``url``; ``outcomes`` has ``page_id`` and ``bad`` (0, 1 or
    null) and may name a page not at all or repeatedly: every outcome counts once, for each row of its page.
    Null urls have an empty host, a host like any other. Without outcomes every host has the same
    rate and is allowed. Repeated pages are repeated in the result; other columns are ignored.
    """
    seen = outcomes.where("bad is not null and page_id is not null").select(F.col("page_id").alias("__id"), F.col("bad").cast("long").alias("bad"))
    seen = seen.groupBy("__id").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    urls = pages.select("page_id", url_host("url").alias("host"), url_path("url").alias("path"))
    hosts = (
        urls.select("page_id", "host")
        .join(seen, F.col("page_id") == F.col("__id"), "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(hosts, max_bad, z).select("host", "n", "rate", "bound", "judged")
    return urls.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, "judged").alias("verdict"),
        F.col("n").alias("labelled"), F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_bound"),
    )
