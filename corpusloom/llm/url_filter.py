"""URL rules by hash-prefix lookup (DataFrame functions only).

Each URL is expanded into expressions: every suffix of its host at a label
boundary, with every prefix of its path that has the length of some rule's
path.  The first 4 bytes of an expression's SHA-256 are the short key of an
equi-join with the rules; the full digest then confirms the match, and of the
confirmed rules the longest (host and path together, then host, then
alphabetically) gives the verdict.  URLs that no rule fits are allowed.

Defined cases: a null url or one without ``://`` has empty host and path and
fits no rule; of rules with the same host and path the one whose verdict comes
last in order holds (block before allow), rules without one of them fit nothing;
a very long url makes as many expressions as it has labels times fitting
lengths; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, skew_safe_lookup

DEFAULT_VERDICT = "allow"
#: (host, path, verdict) of the production query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def expressions(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """Host suffixes times path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    lengths = F.lit(list(path_lengths)) if path_lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\x00"), p))))
    return F.when(host != "", pairs).otherwise(F.array().cast("array<string>"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict.

    ``rules`` (rule_host, rule_path, rule_verdict) are counted: up to
    BROADCAST_ROWS they are broadcast, beyond that the distinct expressions are
    shuffled to them instead.  Of the rules' paths only the distinct lengths
    come to the driver, numbers that the longest path bounds.
    """
    rules = rules.filter("rule_host is not null and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    full = digest(F.concat("rule_host", F.lit("\x00"), "rule_path"))
    keyed = rules.select(
        F.substring(full, 1, 8).alias("short"),
        full.alias("rule_digest"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"),
        "rule_verdict",
    )
    host, path = split_url(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col("page_id"), host.alias("host"), path.alias("path"))
    wide = rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    wide = wide.select("_row", "page_id", "host", "path", digest(F.col("expression")).alias("digest"))
    if rules.count() <= BROADCAST_ROWS:
        hit = wide.withColumn("short", F.substring("digest", 1, 8)).join(F.broadcast(keyed), "short", "left")
        hit = hit.withColumn("ok", F.col("digest") == F.col("rule_digest"))
    else:
        seen = wide.groupBy("digest").agg(F.count("*").alias("n_seen")).withColumn("short", F.substring("digest", 1, 8))
        confirmed = seen.join(keyed, "short").filter("digest = rule_digest").drop("short")
        hit = skew_safe_lookup(wide, confirmed, "digest", "n_seen").withColumn("ok", F.col("rule_digest").isNotNull())
    best = F.max(
        F.when(
            F.col("ok"),
            F.struct(F.length("rule").alias("n"), F.col("host_length"), F.col("rule"), F.col("rule_verdict")),
        )
    )
    return (
        hit.groupBy("_row", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
    )


def _oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH r(rh, rp, rv) AS (VALUES {values}),
s AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
u AS (
  SELECT k, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM s
),
m AS (
  SELECT u.k, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY u.k ORDER BY length(rh || rp) DESC, length(rh) DESC, rh || rp DESC) AS rn
  FROM u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.rv, '{DEFAULT_VERDICT}') AS verdict
FROM u LEFT JOIN m ON u.k = m.k AND m.rn = 1
"""


ORACLE_SQL = _oracle()
