"""URL filters by host reputation, in DataFrame functions only.

Labelled page outcomes (1: bad, 0: good) are counted by host. A host's rate of
bad pages is shrunk by beta-binomial priors in three steps: the suffix towards
the rate of all pages, the registered domain towards its suffix, the host
towards its domain. How much each level is trusted (its concentration) comes
from the spread that the level itself shows, by moments. A host is blocked when
the lower bound of its posterior rate (mean less Z standard deviations) passes
BLOCK_RATE, so a few bad labels alone block nothing. Rules of host and path go
first.

Pages are grouped by host with partial counts and joined once, to one row a
host; only id, host and path of a page are moved. Rules are a joined table,
looked up by the hosts' parents.

Null urls and those without ``://`` have an empty host and path and are judged
by the rate of such pages. Very long urls are read whole; of a host's parents
only as many labels are built as the longest rule has. Repeated rows are judged
each on its own. A label counts once for each page row of its id; labels
without an outcome, or of no page, count nothing. Without labels the prior is
one bad page in two unknown ones. Empty tables give an empty result. Columns of
the input that clash with a result's are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A host is blocked when its rate of bad pages is above this, by the bound.
BLOCK_RATE = 0.5
Z = 1.645
#: Bounds of the share of a level's variance that lies between its groups.
LEAST_RHO, MOST_RHO = 0.001, 0.5
# Second-level labels that belong to a country's suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: The rules of the registered query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _site(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user and port."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    bare = F.regexp_replace(bare, r":[0-9]*$|\.$", "")
    number = bare.rlike(r"^[0-9.]+$|\[")
    suffix = F.when(number, "").otherwise(F.coalesce(
        F.nullif(F.regexp_extract(bare, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1), F.lit("")),
        F.substring_index(bare, ".", -1)))
    labels = F.size(F.split(suffix, r"\.")) + 1
    domain = F.when(number, bare).otherwise(
        F.array_join(F.slice(F.split(bare, r"\."), -F.least(labels, F.size(F.split(bare, r"\."))), labels), "."))
    return domain, suffix


def _rho(bad: Column, n: Column, mean: Column) -> list[Column]:
    """Sums from which a level's concentration follows."""
    return [F.sum((bad - n * mean) * (bad - n * mean) / (mean * (1 - mean))).alias("chi"),
            F.sum(n).alias("n"), F.sum(n * (n - 1)).alias("pairs")]


def _concentration(level: DataFrame, mean: str) -> float:
    """Prior weight of a level's groups, in pages: 1 / rho - 1, where the
    squared deviations of all groups from ``mean`` have the expectation
    sum(n (1 + (n - 1) rho))."""
    r = level.where("n > 0").agg(*_rho(F.col("bad"), F.col("n"), F.col(mean))).first()    # one row
    rho = (r["chi"] - r["n"]) / r["pairs"] if r["pairs"] else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, bad_rate, bad_bound) of ``outcomes`` (host, bad: 1, 0 or
    null where the page has no label)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = _site(F.col("host"))
    hosts = common.cut(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "url-hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()            # one row
    mean = (total["bad"] + 1) / (total["n"] + 2)
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(mean))
    s = _concentration(suffixes, "prior")
    suffixes = suffixes.select("suffix", _clip((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    domains = hosts.groupBy("suffix", "domain").agg(*counts).join(suffixes, "suffix")
    s = _concentration(domains, "prior")
    domains = domains.select("domain", "suffix",
                             _clip((F.col("bad") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    hosts = hosts.join(domains, ["suffix", "domain"])
    s = _concentration(hosts, "prior")
    a, b = F.col("bad") + s * F.col("prior"), F.col("n") - F.col("bad") + s * (1 - F.col("prior"))
    rate = a / (a + b)
    return hosts.select("host", "n", "bad", rate.alias("bad_rate"),
                        (rate - z * F.sqrt(a * b / (a + b + 1)) / (a + b)).alias("bad_bound"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, rule_verdict)."""
    if not rules:
        return spark.sql("SELECT '' AS rule_host, '' AS rule_path, '' AS rule, '' AS rule_verdict WHERE false")
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("rule_host"), F.lit("/" + r.partition("/")[2]).alias("rule_path"),
                     F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and its parents, longest first;
    the rules of one host travel as one array."""
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0          # one row
    parts, size = F.split("host", r"\."), F.size(F.split("host", r"\."))
    parents = F.transform(F.sequence(F.greatest(F.lit(1), size - most + 1), size),
                          lambda i: F.array_join(F.slice(parts, i, size - i + 1), "."))
    return (hosts.select("host", F.explode(F.array_distinct(parents)).alias("rule_host")).join(rules, "rule_host")
            .groupBy("host").agg(F.reverse(F.sort_array(F.collect_list(F.struct(
                F.length("rule").alias("size"), "rule", "rule_path", "rule_verdict")))).alias("rules")))


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
          label_id: str = "doc_id", bad: Column | None = None, block_rate: float = BLOCK_RATE) -> DataFrame:
    """``pages`` with host, path, rule (null: none fits), verdict, and the
    host's ``bad_rate`` and its lower bound ``bad_bound``. ``bad`` is the outcome
    (1, 0 or null) of a row of ``labels``."""
    if bad is None:
        bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    pages = pages.drop(*(c for c in _NAMES if c not in (page_id, url)))
    found = pages.select(F.col(page_id).alias("id"), host_of(F.col(url)).alias("host"))
    marks = labels.select(F.col(label_id).alias("id"), bad.cast("long").alias("bad")).where("bad IS NOT NULL")
    known = reputations(found.join(marks, "id", "left").select("host", "bad"))
    hosts = known.join(_host_rules(known.select("host"), rules), "host", "left").select(
        F.col("host").alias("_u_host"), F.col("bad_rate").alias("_u_rate"), F.col("bad_bound").alias("_u_bound"),
        F.col("rules").alias("_u_rules"))
    out = (pages.withColumn("_u_host", host_of(F.col(url))).withColumn("_u_path", path_of(F.col(url)))
           .join(hosts, "_u_host"))
    fits = F.filter("_u_rules", lambda r: F.startswith(F.col("_u_path"), r["rule_path"]))
    out = out.withColumn("_u_rule", F.try_element_at(fits, F.lit(1)))
    method = F.when(F.col("_u_bound") > block_rate, "block").otherwise("allow")
    return out.select(*pages.columns, F.col("_u_host").alias("host"), F.col("_u_path").alias("path"),
                      F.col("_u_rule.rule").alias("rule"),
                      F.coalesce("_u_rule.rule_verdict", method).alias("verdict"),
                      F.col("_u_rate").alias("bad_rate"), F.col("_u_bound").alias("bad_bound"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the row of ``labels`` with its id: bad when it is of
    low quality or toxic."""
    pages = common.table(spark, sf_dir, "pages", "page_id", "url")
    labels = common.table(spark, sf_dir, "labels")
    out = judge(pages, labels, rule_table(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
bare AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'g'),
           ':[0-9]*$|\\.$', '', 'g') AS b FROM p),
site AS (
  SELECT host, b, regexp_matches(b, '^[0-9.]+$|\\[') AS number,
         coalesce(nullif(regexp_extract(b, '(?:^|\\.)((?:{'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}})$', 1), ''),
                  list_extract(string_split(b, '.'), -1)) AS s FROM bare),
dom AS (
  SELECT host, CASE WHEN number THEN '' ELSE s END AS suffix,
         CASE WHEN number THEN b ELSE array_to_string(list_slice(string_split(b, '.'),
           greatest(len(string_split(b, '.')) - len(string_split(s, '.')), 1), len(string_split(b, '.'))), '.') END AS domain
  FROM site),
hosts AS (
  SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM p LEFT JOIN (SELECT doc_id, greatest(CASE WHEN quality IS NULL THEN NULL ELSE 1 - quality END, toxic) AS bad
                    FROM labels) l ON page_id = doc_id JOIN dom USING (host) GROUP BY ALL),
m AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS prior FROM hosts, m GROUP BY suffix),
c0 AS (SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN
         (sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / sum(n * (n - 1)) ELSE {LEAST_RHO} END,
         {LEAST_RHO}), {MOST_RHO}) - 1 AS c FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, least(greatest((bad + c * prior) / (n + c), 1e-6), 1 - 1e-6) AS prior
       FROM s0, (SELECT coalesce(max(c), 1 / {LEAST_RHO} - 1) AS c FROM c0)),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior
       FROM hosts JOIN s1 USING (suffix) GROUP BY ALL),
c1 AS (SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN
         (sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / sum(n * (n - 1)) ELSE {LEAST_RHO} END,
         {LEAST_RHO}), {MOST_RHO}) - 1 AS c FROM d0 WHERE n > 0),
d1 AS (SELECT suffix, domain, least(greatest((bad + c * prior) / (n + c), 1e-6), 1 - 1e-6) AS prior
       FROM d0, (SELECT coalesce(max(c), 1 / {LEAST_RHO} - 1) AS c FROM c1)),
h0 AS (SELECT host, n, bad, prior FROM hosts JOIN d1 USING (suffix, domain)),
c2 AS (SELECT 1 / least(greatest(CASE WHEN sum(n * (n - 1)) > 0 THEN
         (sum((bad - n * prior) ** 2 / (prior * (1 - prior))) - sum(n)) / sum(n * (n - 1)) ELSE {LEAST_RHO} END,
         {LEAST_RHO}), {MOST_RHO}) - 1 AS c FROM h0 WHERE n > 0),
ab AS (SELECT host, bad + c * prior AS a, n - bad + c * (1 - prior) AS b
       FROM h0, (SELECT coalesce(max(c), 1 / {LEAST_RHO} - 1) AS c FROM c2)),
rep AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / (a + b + 1)) / (a + b) AS bound FROM ab),
rules(v, h, pa, r) AS (VALUES {', '.join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)}),
pk AS (SELECT DISTINCT host, path FROM p),
hit AS (SELECT host, path, arg_max(r, length(r)) AS rule, arg_max(v, length(r)) AS v FROM pk JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN bound > {BLOCK_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN rep USING (host) LEFT JOIN hit ON hit.host = p.host AND hit.path = p.path
"""
