"""Filters of urls: rules, and the reputation of hosts where no rule fits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import free_name, stored

#: Public suffixes of more than one label that are told without a list of the caller's.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp ac.jp com.br com.cn com.mx co.in co.kr co.za com.tr com.tw".split())
#: How alike the outcomes of a group are (0 to 1) before any group is seen; it weighs as much as one group.
FIRST_ALIKE = 0.5
#: The least and the most that groups can make of it.
LEAST_ALIKE, MOST_ALIKE = 1e-4, 0.99


class Rule(NamedTuple):
    """A verdict for a host, its subdomains and the paths that start with `path`."""

    verdict: str
    host: str
    path: str


def rule(verdict: str, text: str) -> Rule:
    """The rule of a text like `example.com/en/`."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with host and path: what stands behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, and from there up to `?`, `#` or the end.

    Both are empty for nulls and urls without `://`; columns of these names are replaced.
    """
    rest = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def with_rule(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of host and path with rule (host and path of the longest that fits, else null) and ruled, its verdict. Among rules of one length that of the longer host stands."""
    best: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.host)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        best, verdict = F.when(fits, r.host + r.path).otherwise(best), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumns({"rule": best, "ruled": verdict})


def with_domain(rows: DataFrame, suffixes: frozenset[str] = SUFFIXES) -> DataFrame:
    """Rows of host with domain and suffix.

    The suffix is the host's last label, or its last two if they are one of `suffixes`; the registered domain has one label more. User names and
    ports are left out; a host that is a suffix or a number is its own domain, an empty one belongs to the empty domain.
    """
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$|\.+$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    long = last(2).isin(sorted(suffixes))
    number = bare.rlike(r"^[0-9.]+$|^\[")
    return rows.withColumns({"domain": F.when(number, bare).when(long, last(3)).otherwise(last(2)), "suffix": F.when(number, "").when(long, last(2)).otherwise(last(1))})


def _alike(rows: DataFrame, share: Column) -> float:
    """How alike the outcomes of a row are, of which y of n are bad, if rows spread around `share`: 1 / (c + 1) of a beta prior of concentration c, by moments.

    Of beta-binomial counts E(y - n p)^2 = n p (1 - p) (1 + (n - 1) r). FIRST_ALIKE is the outcome of one more row, so that a few rows do not
    prove that all are the same.
    """
    spread = share * (1 - share)
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    over, room = (y - n * share) * (y - n * share) - n * spread, n * (n - 1) * spread
    r = rows.filter("n > 1").select(F.sum(over).alias("over"), F.sum(room).alias("room"), F.count("*").alias("rows")).first()
    alike = r["over"] / r["room"] if r["room"] else 0.0
    return min(max((max(alike, 0.0) * r["rows"] + FIRST_ALIKE) / (r["rows"] + 1), LEAST_ALIKE), MOST_ALIKE)


def _discounted(rows: DataFrame, alike: float) -> DataFrame:
    """n and y of rows, as w_n and w_y, as far as they tell of the group above: outcomes of one row are alike, so many of them count little more than some."""
    share = 1 / (1 + F.greatest(F.col("n") - 1, F.lit(0.0)) * alike)
    return rows.withColumns({"w_n": F.col("n") * share, "w_y": F.col("y") * share})


def _below(mean: Column, weight: Column, alike: float, n: Column, y: Column) -> tuple[Column, Column]:
    """Mean and concentration of a group's posterior from those of the group above and n outcomes, y of them bad.

    The prior is a beta distribution around a mean that is itself uncertain; its concentration p matches the variance of both: 1 - 1/(p + 1) is the
    product of that of either.
    """
    kept = weight / (weight + 1) * (1 - alike)
    prior = kept / (1 - kept)
    n, y = F.greatest(n, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    return (y + prior * mean) / (n + prior), n + prior


def reputations(outcomes: DataFrame, level: float = 0.95, suffixes: frozenset[str] = SUFFIXES) -> DataFrame:
    """host, n, y, share and bound of hosts from outcomes(host, n, y): n labelled pages of which y are bad; a host may have several rows, and n may be 0.

    share is the mean of a host's posterior, a beta distribution: its own outcomes on top of a prior from the registered domain's other hosts, this on
    top of one from the suffix's other domains, and this on top of one from all other suffixes, which starts at a half. So every outcome
    counts once. How far hosts, domains and suffixes spread is learned level by level from all of them, and each prior carries the
    uncertainty of the one above. bound is what the true share exceeds with a probability of at least `level`, whatever the distribution's
    form (Cantelli): mean - sqrt(level / (1 - level)) deviations. Null outcomes count as none. Hosts are summed
    before the shuffle; the levels are sums of sums and come back by joins, so that no task holds a suffix.
    """
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("double").alias(c)
    sums = lambda prefix="": (F.sum("w_n").alias(f"n{prefix}"), F.sum("w_y").alias(f"y{prefix}"))
    mean = lambda n, y: (y + 0.5) / (n + 1.0)
    c = F.col
    hosts = stored(with_domain(outcomes.groupBy("host").agg(count("n"), count("y")), suffixes), "hosts")
    of_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("y").alias("y_d"))
    by_host = _alike(hosts.join(of_domain, ["domain", "suffix"]), mean(c("n_d"), c("y_d")))
    hosts = _discounted(hosts, by_host)
    domains = stored(hosts.groupBy("domain", "suffix").agg(*sums()), "domains")
    of_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n_s"), F.sum("y").alias("y_s"))
    by_domain = _alike(domains.join(of_suffix, "suffix"), mean(c("n_s"), c("y_s")))
    domains = _discounted(domains, by_domain)
    ends = stored(domains.groupBy("suffix").agg(*sums()), "suffixes")
    plain = ends.agg(count("n"), count("y")).first()
    by_suffix = _alike(ends, F.lit(mean(plain["n"] or 0.0, plain["y"] or 0.0)))
    ends = _discounted(ends, by_suffix)
    whole = ends.agg(F.coalesce(F.sum("w_n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("w_y"), F.lit(0.0)).alias("y")).first()
    domains = domains.join(ends.select("suffix", c("n").alias("n_s"), c("y").alias("y_s"), c("w_n").alias("w_n_s"), c("w_y").alias("w_y_s")), "suffix")
    upper = domains.select("domain", "suffix", c("n").alias("n_d"), c("y").alias("y_d"), c("w_n").alias("w_n_d"), c("w_y").alias("w_y_d"), "n_s", "y_s", "w_n_s", "w_y_s")
    rows = hosts.join(upper, ["domain", "suffix"])
    other_n, other_y = F.greatest(F.lit(whole["n"]) - c("w_n_s"), F.lit(0.0)), F.greatest(F.lit(whole["y"]) - c("w_y_s"), F.lit(0.0))
    at = mean(other_n, other_y), other_n + 1.0
    at = _below(*at, by_suffix, c("n_s") - c("w_n_d"), c("y_s") - c("w_y_d"))
    at = _below(*at, by_domain, c("n_d") - c("w_n"), c("y_d") - c("w_y"))
    share, weight = _below(*at, by_host, c("n"), c("y"))
    deviation = F.sqrt(F.greatest(c("share") * (1 - c("share")), F.lit(0.0)) / (c("weight") + 1))
    found = rows.select("host", c("n").cast("long").alias("n"), c("y").cast("long").alias("y"), share.alias("share"), weight.alias("weight"))
    return found.select("host", "n", "y", "share", (c("share") - (level / (1 - level)) ** 0.5 * deviation).alias("bound"))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, level: float = 0.95, suffixes: frozenset[str] = SUFFIXES, url_col: str = "url") -> DataFrame:
    """The rows with host, path, rule, verdict, share and bound (of the host; see `reputations`).

    A page that a rule fits takes its verdict, and is an outcome of its host. All others are blocked if the bound of their host is above the threshold,
    that is if at least that share of the host's pages is bad with a probability of at least `level`. Nulls and urls without an address belong to
    the empty host; repeated rows count as often as they occur; columns of the new names are replaced.
    """
    rows = with_rule(with_parts(pages.drop("rule", "ruled", "verdict", "share", "bound"), url_col), rules)
    outcomes = rows.groupBy("host").agg(F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("y"))
    known = stored(reputations(outcomes, level, suffixes), "reputations")
    key = free_name(rows.columns, "of_host")
    found = rows.join(known.select(F.col("host").alias(key), "share", "bound"), F.col("host") == F.col(key)).drop(key)
    verdict = F.coalesce("ruled", F.when(F.col("bound") > threshold, "block").otherwise("allow"))
    return found.withColumn("verdict", verdict).drop("ruled")


def kept_pages(pages: DataFrame, rules: Sequence[Rule], **settings: object) -> DataFrame:
    """The rows of pages that are allowed, with their own columns alone."""
    return judge(pages, rules, **settings).filter("verdict = 'allow'").select(*pages.columns)
