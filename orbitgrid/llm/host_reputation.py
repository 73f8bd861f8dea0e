"""URL filters by empirical-Bayes host reputation (operator 4), in DataFrame functions only.

Labelled page outcomes are counted by host. Beta-binomial priors shrink them level by level:
suffixes towards the whole, registered domains towards their suffix, hosts towards their
registered domain. Each level's prior strength comes from its members' spread (method of
moments). Members that differ no more than chance would have them have an estimate of zero or below: the
strength is then `MAX_STRENGTH`, a numeric limit far above the outcomes of any host, and all share their parent's
mean. So where hosts do not differ, none is blocked.

The filter is one of admission: a host is blocked if the lower bound of its posterior good share
stays below `min_share` of the good share of all outcomes, and either its own outcomes pull it
below its domain or its domain's mean is below that limit itself. So a host without outcomes is
blocked with a bad domain only. Allow and block rules for hosts and path prefixes go before that.

A page's outcome is the quality label of the document whose number ends its url's path: those
pages carry that document's text.

Null urls and urls without `://` have an empty host and path; they share the reputation of the
empty host. Outcomes without a label say nothing. Without any outcome nothing is blocked but
by rule. Rows that repeat are judged and counted each. An empty table of pages gives no rows.
Other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which domains are registered; others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "org.au", "org.uk")
MIN_SHARE, Z, MAX_STRENGTH = 0.75, 1.645, 1e9
#: Spread between members at which the prior is worth MAX_STRENGTH outcomes: none, but for rounding.
LEAST_SPREAD = 1 / (MAX_STRENGTH + 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def rule_action(rule: Column, rules=RULES) -> Column:
    return reduce(lambda out, r: F.when(rule == r[1], F.lit(r[0])).otherwise(out), rules, F.lit(None).cast("string"))


def with_domain(df: DataFrame, host: str = "host") -> DataFrame:
    """`df` with registered domain and suffix; credentials and ports are no part of either."""
    site = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last = [F.substring_index(F.col("__site"), ".", -i) for i in (1, 2, 3)]
    two = last[1].isin(*TWO_LABEL_SUFFIXES)
    return (
        df.withColumn("__site", site)
        .withColumns({"suffix": F.when(two, last[1]).otherwise(last[0]), "domain": F.when(two, last[2]).otherwise(last[1])})
        .drop("__site")
    )


def strength(members: DataFrame, mean: str) -> DataFrame:
    """One row with the beta prior's strength s: from the spread of k/n about `mean`, by moments.

    rho = (sum n (k/n - m)^2 / (m (1 - m)) - members) / sum (n - 1), kept in [LEAST_SPREAD, 0.9]; s = 1/rho - 1.
    """
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(mean)))
    seen = members.filter("n > 0")
    spread = F.sum(F.col("n") * (F.col("k") / F.col("n") - m) ** 2 / (m * (1 - m)))
    free = F.sum(F.col("n") - 1)
    rho = F.when(free > 0, (spread - F.count("*")) / free).otherwise(F.lit(0.1))
    return seen.agg((1 / F.greatest(F.lit(LEAST_SPREAD), F.least(F.lit(0.9), rho)) - 1).alias("s"))


def shrunk(members: DataFrame, mean: str, out: str) -> DataFrame:
    """`members` (n, k, the parent's `mean`) with their posterior mean `out` and the strength `s`."""
    one = F.broadcast(strength(members, mean))  # a single row
    return members.join(one).withColumn(out, (F.col("k") + F.col("s") * F.col(mean)) / (F.col("n") + F.col("s")))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host from (host, good): host, n, k, alpha, beta, mean, lower, upper, and its domain's and all outcomes' good share. Null `good`: not labelled."""
    hosts = with_domain(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"))
    suffixes = shrunk(suffixes.join(F.broadcast(top)), "m0", "m1").select("suffix", "m0", "m1")
    domains = shrunk(domains.join(suffixes, "suffix"), "m1", "m2").select("domain", "m0", "m2")
    hosts = shrunk(hosts.join(domains, "domain"), "m2", "mean")
    a, b = F.col("alpha"), F.col("beta")
    sd = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return (
        hosts.withColumns({"alpha": F.col("k") + F.col("s") * F.col("m2"), "beta": F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m2"))})
        .withColumns({"lower": F.greatest(F.lit(0.0), F.col("mean") - Z * sd), "upper": F.least(F.lit(1.0), F.col("mean") + Z * sd)})
        .select("host", "domain", "suffix", "n", "k", "alpha", "beta", "mean", "lower", "upper", F.col("m2").alias("domain_mean"), F.col("m0").alias("all_mean"))
    )


def not_admitted(min_share: float = MIN_SHARE) -> Column:
    """Whether a host of `host_reputation` is blocked."""
    limit = min_share * F.col("all_mean")
    return (F.col("lower") < limit) & ((F.col("k") < F.col("n") * F.col("domain_mean")) | (F.col("domain_mean") < limit))


def judged(pages: DataFrame, outcomes: DataFrame, min_share: float = MIN_SHARE, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; `outcomes` has (host, good) of labelled pages."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    every = rows.select("host", F.lit(None).cast("int").alias("good")).unionByName(outcomes.select("host", "good"))
    bad = host_reputation(every).filter(not_admitted(min_share)).select("host", F.lit("block").alias("by_host"))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return rows.join(bad, "host", "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(rule_action(F.col("rule"), rules), "by_host", F.lit("allow")).alias("verdict")
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of pages whose url's path ends with the number of a labelled document."""
    url = F.col("url").cast("string")
    number = F.regexp_extract(url_path(url), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    keyed = pages.select(url_host(url).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("most")).filter("good = most")
    return keyed.join(known, "doc_id").select("host", F.col("good").cast("int").alias("good"))


def _fits(rule: str) -> str:
    name, slash, rest = rule.partition("/")
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"


def _shrink(table: str, mean: str) -> str:
    return f"""(SELECT 1 / greatest({LEAST_SPREAD}::double, least(0.9, CASE WHEN sum(n - 1) > 0 THEN
      (sum(n * (k / n - greatest(1e-6, least(1 - 1e-6, {mean}))) ** 2 / (greatest(1e-6, least(1 - 1e-6, {mean})) * (1 - greatest(1e-6, least(1 - 1e-6, {mean}))))) - count(*)) / sum(n - 1)
      ELSE 0.1 END)) - 1 FROM {table} WHERE n > 0)"""


_RULES = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
o AS (SELECT host, good FROM p JOIN known ON known.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html|/)?$', 1), '') AS bigint)),
h0 AS (SELECT host, count(good)::double AS n, coalesce(sum(good), 0)::double AS k FROM (SELECT host, NULL AS good FROM p UNION ALL SELECT host, good FROM o) GROUP BY host),
h1 AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM h0),
h AS (SELECT host, n, k, CASE WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix, CASE WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)}) AS two FROM h1)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s0) AS m0 FROM s0),
s2 AS (SELECT *, {_shrink("s1", "m0")} AS s FROM s1),
s AS (SELECT suffix, m0, (k + s * m0) / (n + s) AS m1 FROM s2),
d1 AS (SELECT domain, n, k, m0, m1 FROM d JOIN s USING (suffix)),
d2 AS (SELECT *, {_shrink("d1", "m1")} AS s FROM d1),
dm AS (SELECT domain, m0, (k + s * m1) / (n + s) AS m2 FROM d2),
h2 AS (SELECT host, n, k, m0, m2 FROM h JOIN dm USING (domain)),
h3 AS (SELECT *, {_shrink("h2", "m2")} AS s FROM h2),
ab AS (SELECT *, k + s * m2 AS a, n - k + s * (1 - m2) AS b FROM h3),
bad AS (SELECT host FROM ab WHERE greatest(0, a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))) < {MIN_SHARE} * m0 AND (k < n * m2 OR m2 < {MIN_SHARE} * m0)),
r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for _, rule in _RULES)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{rule}' THEN '{action}'" for action, rule in RULES)}
  ELSE CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""
