"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, then confirmed.

DataFrame operations only. Every URL is expanded into (host suffix, path prefix) expressions; they meet the
rules on the first characters of a SHA-256 digest, full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import each_way, way_of, ways_used

#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_PATH_LENGTHS = 1000


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url):
    """(host, path) columns of a URL column: both empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_chars: int = 8,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the rule's.
    The longest rule text wins; at equal length the longer host, then ``block``. Without a rule the verdict
    is ``default``. ``prefix_chars`` sets the hash prefix of the join; results don't depend on it.

    Defined cases: a null URL or one without ``://`` has empty host and path, and no rule fits an empty host;
    repeated pages and ids give one row each; rules with a null host or path are ignored; no rules or no
    pages give no rule or an empty result; other columns are ignored. The rules' distinct path lengths decide
    which path prefixes are made; there may be up to MAX_PATH_LENGTHS of them.
    """
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .withColumn("rule", F.concat("host", "path"))
        .groupBy("rule", "host")
        .agg(F.max("verdict").alias("verdict"))  # 'block' follows 'allow'
        .select(
            "rule",
            F.length("rule").alias("_len"),
            F.length("host").alias("_host_len"),
            "verdict",
            F.sha2(F.concat_ws("\x00", "host", F.substr("rule", F.length("host") + 1)).cast("binary"), 256).alias("_digest"),
        )
        .withColumn("_prefix", F.substring("_digest", 1, prefix_chars))
    )
    lengths = [
        r[0]
        for r in rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.length("path")).distinct().limit(MAX_PATH_LENGTHS + 1).collect()
    ]
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"the rules have paths of more than {MAX_PATH_LENGTHS} lengths")
    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")).select(
        "page_id", host.alias("host"), path.alias("path"), way_of("page_id").alias("_way")
    )
    # Copies of a (host, path) are looked up once; the row of a page needs only its own pair, and those of a frequent
    # pair, or without a host, meet their verdict in many tasks.
    labels = F.split("host", r"\.")
    expressions = (
        parts.where("host != ''")
        .groupBy("host", "path")
        .agg(ways_used("_way").alias("_ways"))
        .withColumn("_labels", labels)
        .withColumn("_suffix", F.explode(F.expr("transform(sequence(1, size(_labels)), i -> array_join(slice(_labels, i, size(_labels)), '.'))")))
        .withColumn("_n", F.explode(F.array(*[F.lit(int(n)) for n in sorted(lengths)]) if lengths else F.expr("array_repeat(0, 0)")))
        .where(F.length("path") >= F.col("_n"))
        .withColumn("_made", F.sha2(F.concat_ws("\x00", "_suffix", F.expr("left(path, _n)")).cast("binary"), 256))
        .select("host", "path", "_ways", "_made", F.substring("_made", 1, prefix_chars).alias("_prefix"))
    )
    best = (
        expressions.join(known, "_prefix")
        .where("_made = _digest")
        .groupBy("host", "path", "_ways")
        .agg(F.max(F.struct("_len", "_host_len", "verdict", "rule")).alias("_best"))
        .select("host", "path", each_way("_ways").alias("_way"), F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_verdict"))
    )
    return parts.join(best, ["host", "path", "_way"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )
