"""URL filtering: explicit rules first, then an empirical-Bayes reputation of hosts.

Labelled pages (bad or not) are counted per host.  Each level's rate is shrunk towards the level above it:
host to registered domain to public suffix to all pages.  The strength of a level's beta prior is
estimated from the spread of the rates at that level (method of moments, Kleinman 1973).  A page without a rule
is blocked when the lower bound of its host's posterior rate is above ``BLOCK_RATE``.  A host without labels has no
counts of its own, so its posterior is the prior that its domain, else its suffix, else all pages give.

A few rules are literals of the plan.  More of them are joined: the names above a host with the hosts of rules, then
prefixes of its paths, only of the lengths that these rules have, with the paths of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules that are literals of the plan; more are joined.
MAX_RULES = 1000
BLOCK_RATE = 0.25
#: Standard deviations between the posterior mean and its lower bound.
BOUND_Z = 1.645
#: Limits of a prior's strength, in pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: Suffixes of two labels below which domains are registered, where no table of suffixes is given.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null; every rule is a literal."""
    fits = [
        F.when(
            ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path),
            F.struct(F.lit(len(r_host + r_path)).alias("length"), F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, r_host, r_path in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def names_above(host: Column, most: int) -> Column:
    """The host and every name above it, from the longest: a.b.com, b.com, com; of them those of at most ``most`` labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _most_labels(names: DataFrame) -> int:
    """The largest number of labels in the one column of ``names``."""
    return names.agg(F.max(F.size(F.split(F.col(names.columns[0]), r"\.")))).first()[0] or 1


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path) with ``fit`` as by ``rule_of``, for any number of ``rules`` (verdict, host, path).

    Each different url is looked up once.  A rule's host and path are one row of the table that is joined, so a rule that fits
    a third of all urls makes as many rows as there are such urls.
    """
    table = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").where("r_host is not null and r_path is not null and verdict is not null").groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))
    lengths = table.select("r_host", F.length("r_path").alias("length")).distinct()
    most = _most_labels(table.select("r_host"))
    known = urls.select("host", "path").distinct()
    above = known.select("host").distinct().select("host", F.explode(names_above(F.col("host"), most)).alias("r_host"))
    prefixes = known.join(above.join(lengths, "r_host"), "host").select("host", "path", "r_host", F.expr("substring(path, 1, length)").alias("r_path"))
    rule = F.concat("r_host", "r_path")
    fits = prefixes.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("length"), rule.alias("rule"), "verdict")).alias("fit"))
    return urls.join(fits, ["host", "path"], "left")


def _bare(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^(\d+(\.\d+){3}|\[.*)$")


def suffix_of(host: Column) -> Column:
    """Its last label, or two of ``TWO_LABEL_SUFFIXES``; empty for an IP address."""
    bare = _bare(host)
    two = F.regexp_extract(bare, r"(?:^|\.)([^.]+\.[^.]+)$", 1)
    return F.when(_is_address(bare), "").when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(bare, r"(?:^|\.)([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; a host without such a label, or an IP address, is its own domain."""
    bare = _bare(host)
    three = F.regexp_extract(bare, r"(?:^|\.)([^.]+\.[^.]+\.[^.]+)$", 1)
    two = F.regexp_extract(bare, r"(?:^|\.)([^.]+\.[^.]+)$", 1)
    return F.when(_is_address(bare), bare).when(two.isin(*TWO_LABEL_SUFFIXES) & (three != ""), three).when(two != "", two).otherwise(bare)


def with_parents(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row per host) with ``domain`` and ``suffix``.

    ``suffixes`` has one column ``suffix``: public suffixes in lower case, of any number of labels; the longest one that ends a
    host counts, and a host below none of them has its last label.  Wildcards are not read: list what they stand for.
    """
    if suffixes is None:
        return hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    public = suffixes.select(F.col("suffix").alias("name")).where("name is not null").distinct()
    above, address = names_above(_bare(F.col("host")), _most_labels(public) + 1), _is_address(_bare(F.col("host")))
    names = hosts.select("host", F.posexplode(above).alias("place", "name"))
    longest = names.join(public, "name").groupBy("host").agg(F.min("place").alias("place"))
    place = F.coalesce(F.col("place"), F.size(above) - 1)
    return (
        hosts.join(longest, "host", "left")
        .withColumn("domain", F.when(address, _bare(F.col("host"))).otherwise(F.get(above, F.greatest(F.lit(0), place - 1))))
        .withColumn("suffix", F.when(address, "").otherwise(F.get(above, place)))
        .drop("place")
    )


def _strength(bad: Column, n: Column, prior: Column) -> Column:
    """Strength of the prior over units with ``bad`` of ``n`` and prior rate ``prior``: from chi-square-like excess
    S = sum (bad - n p)^2 / (p q), whose mean is sum n (1 + (n - 1) rho), rho = 1 / (strength + 1)."""
    pq = prior * (1 - prior)
    spread = F.sum(F.when(pq > 0, F.pow(bad - n * prior, F.lit(2)) / pq))
    units = F.sum(F.when(pq > 0, n))
    room = F.sum(F.when(pq > 0, n * (n - 1)))
    rho = (spread - units) / F.nullif(room, F.lit(0.0))
    return F.coalesce(F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), F.when(rho <= 0, F.lit(MAX_STRENGTH)).otherwise(1 / rho - 1))), F.lit(MAX_STRENGTH))


def reputation(labelled: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``labelled`` (host, bad 0/1) to one row per host: n, bad, mean and lower bound of the posterior rate.

    The strengths of three levels are three numbers; they and the overall rate go through the driver.  A
    null ``bad`` is no label; a host with no other has n = bad = 0, adds nothing to the strengths and gets its prior.
    ``suffixes`` as for ``with_parents``.
    """
    counted = labelled.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    hosts = stored(with_parents(counted, suffixes), "url-hosts")  # one row a host; read for every level
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("d_bad"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_bad").alias("s_bad"), F.sum("d_n").alias("s_n"))
    overall = suffixes.agg(F.sum("s_bad"), F.sum("s_n")).first()
    p0 = (overall[0] / overall[1]) if overall[1] else 0.0
    k0 = suffixes.agg(_strength(F.col("s_bad"), F.col("s_n"), F.lit(p0))).first()[0]
    suffixes = suffixes.withColumn("s_rate", (F.col("s_bad") + F.lit(k0 * p0)) / (F.col("s_n") + F.lit(k0)))
    domains = domains.join(suffixes.select("suffix", "s_rate"), "suffix")
    k1 = domains.agg(_strength(F.col("d_bad"), F.col("d_n"), F.col("s_rate"))).first()[0]
    domains = domains.withColumn("d_rate", (F.col("d_bad") + F.lit(k1) * F.col("s_rate")) / (F.col("d_n") + F.lit(k1)))
    hosts = hosts.join(domains.select("domain", "suffix", "d_rate"), ["domain", "suffix"])
    k2 = hosts.agg(_strength(F.col("bad"), F.col("n"), F.col("d_rate"))).first()[0]
    a, b = F.col("bad") + F.lit(k2) * F.col("d_rate"), F.col("n") - F.col("bad") + F.lit(k2) * (1 - F.col("d_rate"))
    mean = a / (a + b)
    return hosts.select("host", "n", "bad", mean.alias("rate"), (mean - BOUND_Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, block_rate: float = BLOCK_RATE, suffixes: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, ``rate`` and ``lower`` of its host.

    ``pages`` has page_id and url, ``labels`` page_id and bad (0/1).  A null url, or one without ``://``, has an
    empty host and path.  ``rules`` are (verdict, host, path), or a table of these columns.  A host without labelled pages is judged by its registered domain, else suffix, else all
    pages; without any labels all are allowed.  Repeated rows are judged alike; repeated labels of a page count each.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = judged.join(labels.select("page_id", "bad"), "page_id").select("host", "bad")
    rep = reputation(labelled.unionByName(judged.select("host", F.lit(None).cast(labels.schema["bad"].dataType).alias("bad"))), suffixes)
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    fit = joined_rules(judged, rules) if isinstance(rules, DataFrame) else judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("lower") > block_rate, "block").otherwise("allow")
    return fit.join(rep.select("host", "rate", "lower"), "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), "rate", "lower"
    )
