"""URL filter by host reputation (empirical Bayes) behind a rule list.

Labelled page outcomes (bad: 0 or 1) are counted per host, registered domain
and suffix. From the top down each level's rate is shrunk towards its parent's by a beta
prior: the prior mean is the parent's posterior mean, its strength follows
from how much the children's rates really differ (method of moments for
the beta-binomial, within fixed limits). A page is blocked when the lower bound of its
most specific level's posterior bad rate passes the tolerated rate. Explicit rules decide first.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, attach, scratch

#: Most rules of a list (they are broadcast as a table).
MAX_RULES = 10_000
#: Prior of the whole corpus (one bad and one good outcome), limits of a level's prior strength.
ROOT_BAD, ROOT_ALL = 1.0, 2.0
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Tolerated bad rate, and how many standard deviations below the mean the bound lies.
TOLERATED, DEVIATIONS = 0.5, 1.645


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def last_labels(host: Column, n: int) -> Column:
    """The last n labels of a host (the host itself if it has fewer)."""
    return F.substring_index(host, ".", -n)


def fitting_rules(hosts: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Distinct hosts (host) -> (host, fits): the rules of the host and the domains above it, longest first.

    The rules are a table joined on their host, which the last labels of a page's host must equal. Equal
    lengths: the first in the list. Hosts without any rule are left out; ``first_fit`` takes the path into account.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rows = []
    for rank, (rule, verdict) in enumerate(sorted(rules, key=lambda r: -len(r[0]))):
        name, slash, rest = rule.partition("/")
        rows.append((name, rank, slash + rest, rule, verdict))
    table = hosts.sparkSession.createDataFrame(rows, "name string, rank int, path string, rule string, verdict string")
    labels = range(1, max((name.count(".") for name, *_ in rows), default=0) + 2)
    names = F.array_distinct(F.array(*[last_labels(F.col("host"), n) for n in labels]))
    # at most MAX_RULES rows
    found = hosts.select("host", F.explode(names).alias("name")).join(F.broadcast(table), "name")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "rule", "verdict"))).alias("fits"))


def first_fit(fits: Column, path: Column) -> Column:
    """The first of a host's rules whose path the page's path starts with; null if none does."""
    return F.get(F.filter(fits, lambda r: F.startswith(path, r["path"])), 0)


def _strength(children: DataFrame) -> float:
    """Prior strength from (n, bad, prior) rows: the children's spread beyond chance, as a beta-binomial has it."""
    chance = F.col("prior") * (1 - F.col("prior"))
    spread, possible = children.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), F.lit(2)) - F.col("n") * chance),
        F.sum(F.col("n") * (F.col("n") - 1) * chance)).first()
    if not possible or spread <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, possible / spread - 1))


@dataclass
class Reputation:
    """Posterior means and prior strengths, level by level."""
    root: float
    strengths: tuple[float, float, float]  # of suffixes, domains, hosts
    suffixes: DataFrame  # suffix, mean
    domains: DataFrame  # domain, mean
    hosts: DataFrame  # host, n, bad


def _mean(strength: float) -> Column:
    return (strength * F.col("prior") + F.col("bad")) / (strength + F.col("n"))


def fit(outcomes: DataFrame) -> Reputation:
    """(host, bad) page outcomes -> reputations. Rows without host or outcome are left out.

    Pages are counted per host before they move, so a host with most of the pages weighs
    no more than another. Three strengths and one rate reach the driver.
    """
    hosts = scratch(outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")), "hosts")
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    root = (bad + ROOT_BAD) / (n + ROOT_ALL)
    named = hosts.select("host", last_labels(F.col("host"), 2).alias("domain"), "n", "bad")
    by_domain = scratch(named.groupBy("domain").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")), "domains")
    with_suffix = by_domain.withColumn("suffix", last_labels(F.col("domain"), 1))
    by_suffix = with_suffix.groupBy("suffix").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("members")).withColumn("prior", F.lit(root))
    s1 = _strength(by_suffix)
    suffixes = scratch(by_suffix.select("suffix", _mean(s1).alias("prior"), "members"), "suffix-rates")
    total = by_domain.count()
    under = attach(with_suffix.withColumnRenamed("members", "hosts"), suffixes, "suffix", "members", total)
    s2 = _strength(under)
    domains = scratch(under.select("domain", _mean(s2).alias("prior"), F.col("hosts").alias("members")), "domain-rates")
    inside = attach(named, domains, "domain", "members", hosts.count())
    s3 = _strength(inside)
    return Reputation(root, (s1, s2, s3), suffixes, domains, hosts)


def bounds(hosts: DataFrame, rep: Reputation) -> DataFrame:
    """Distinct hosts (host) -> host, mean, bound: posterior bad rate and its lower bound.

    A host without outcomes has the beta prior its domain gives it, a domain
    without outcomes its suffix's, a suffix without outcomes the corpus rate.
    """
    s1, s2, s3 = rep.strengths
    total = hosts.count()
    named = hosts.select("host", last_labels(F.col("host"), 2).alias("domain"), last_labels(F.col("host"), 1).alias("suffix"))
    # how many of these hosts look a name up decides whether it counts as heavy
    suffixes = named.groupBy("suffix").agg(F.count(F.lit(1)).alias("seen")).join(
        rep.suffixes.select("suffix", F.col("prior").alias("suffix_mean")), "suffix")
    domains = named.groupBy("domain").agg(F.count(F.lit(1)).alias("seen")).join(
        rep.domains.select("domain", F.col("prior").alias("domain_mean")), "domain")
    x = attach(named, suffixes, "suffix", "seen", total).drop("seen")
    x = attach(x, domains, "domain", "seen", total).drop("seen")
    x = x.join(rep.hosts, "host", "left")
    prior = F.coalesce(F.col("domain_mean"), F.col("suffix_mean"), F.lit(rep.root))
    a = s3 * prior + F.coalesce("bad", F.lit(0.0))
    b = s3 * (1 - prior) + F.coalesce("n", F.lit(0.0)) - F.coalesce("bad", F.lit(0.0))
    x = x.select("host", a.alias("a"), b.alias("b"))
    all_ = F.col("a") + F.col("b")
    mean = F.col("a") / all_
    return x.select("host", mean.alias("mean"),
                    (mean - DEVIATIONS * F.sqrt(F.col("a") * F.col("b") / (all_ * all_ * (all_ + 1)))).alias("bound"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], outcomes: DataFrame | None = None,
          tolerated: float = TOLERATED) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, bad_rate, bound.

    ``outcomes`` (host, bad) are labelled pages; by default the pages that a
    rule decides serve as labels (blocked: bad). A rule's verdict stands;
    any other page is blocked when its host's bound exceeds ``tolerated``. Null urls and urls
    without ``://`` have an empty host and path and are judged by the reputation of
    the empty host. Repeated rows are judged alike; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    cut = scratch(pages.select("page_id", host.alias("host"), path.alias("path")), "page-urls")
    per_host = scratch(cut.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "page-hosts")
    total = cut.count()
    # hosts without a rule too, so that a crowded one is known as such
    fits = per_host.join(fitting_rules(per_host.select("host"), rules), "host", "left").select("host", "fits", "pages")
    ruled = scratch(attach(cut, fits, "host", "pages", total).withColumn("r", first_fit(F.col("fits"), F.col("path")))
                    .select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled")), "pages")
    if outcomes is None:
        outcomes = ruled.where("ruled IS NOT NULL").select("host", (F.col("ruled") == "block").cast("int").alias("bad"))
    rep = fit(outcomes)
    known = per_host.join(bounds(per_host.select("host"), rep), "host")
    out = attach(ruled, known, "host", "pages", total)
    verdict = F.coalesce("ruled", F.when(F.col("bound") > tolerated, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                      F.col("mean").alias("bad_rate"), "bound")
