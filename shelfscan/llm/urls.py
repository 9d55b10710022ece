"""URL filter: rules, and empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain
and public suffix, in the map tasks first. Each level's rate is shrunk to the
level above: a beta-binomial prior centred on the parent's rate, its strength
from the spread of the level's own rates (method of moments). A host without
a labelled page has its domain's rate, a domain without one its suffix's, a
suffix without one that of all labelled pages. A host is
blocked when its bad rate lies above the limit even at the lower end of the
posterior (mean less ``z`` standard deviations). Rules come first.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; outcomes without an id or value are left
out, several of one id count as bad if one is; without outcomes nothing is
blocked by reputation; repeated pages each give their row; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: a host is blocked when its bad rate is above this
LIMIT = 0.25
#: standard deviations from the posterior mean to its bound
Z = 2.0
#: fixed values: public suffixes of two labels
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za", "com.mx", "com.ar")
#: prior strengths are kept between these
STRENGTH = (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the public suffix."""
    three = F.substring_index(host, ".", -3)
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), three).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. ``rules`` is a short list."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string") if rule is None else rule), (F.lit(None).cast("string") if verdict is None else verdict)


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior strength k that explains the spread of the level's rates."""
    sums = level.where("n > 0").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares")
    )
    m = F.col("bad") / F.col("total")
    between = F.col("squares") / F.col("total") - m * m - m * (1 - m) * (F.col("groups") - 1) / F.col("total")
    k = F.when(between > 0, m * (1 - m) / between - 1).otherwise(STRENGTH[1])
    return sums.select(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), k)).alias("k"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, bound) per host of ``pages``; none without any labelled page. ``outcomes``: (page_id, bad)."""
    seen = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    host, _ = split_url(F.col("url"))
    labelled = pages.select("page_id", host.alias("host")).where("host <> ''").join(seen, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("n > 0").select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("rate"))

    def shrunk(level: DataFrame, parent_rate: str) -> Column:
        return (F.col("bad") + F.col("k") * F.col(parent_rate)) / (F.col("n") + F.col("k"))

    top = _with_row(_with_row(suffixes, _strength(suffixes)), whole)
    top = top.select("suffix", shrunk(top, "rate").alias("suffix_rate"))
    middle = _with_row(domains, _strength(domains)).join(top, "suffix")
    middle = middle.select("domain", shrunk(middle, "suffix_rate").alias("domain_rate"))
    low = _with_row(hosts, _strength(hosts)).join(middle, "domain")
    a = F.col("bad") + F.col("k") * F.col("domain_rate")
    total = F.col("n") + F.col("k")
    mean = a / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    return low.select("host", "n", "bad", bound.alias("bound"))


def _with_row(level: DataFrame, row: DataFrame) -> DataFrame:
    """``level`` with the columns of a table of one row."""
    keyed = row.withColumn("one", F.lit(1))
    return level.withColumn("one", F.lit(1)).join(F.broadcast(keyed), "one").drop("one")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT, z: float = Z, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page; ``suffixes`` are the public suffixes of two labels that count as one."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = host_reputation(pages, outcomes, z, suffixes).where(F.col("bound") > limit).select("host", F.lit("block").alias("reputation"))
    joined = split.join(bad, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation", F.lit("allow")).alias("verdict"))
