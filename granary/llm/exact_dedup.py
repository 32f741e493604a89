"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows meet three times, each time on digest *and* full content: inside the map task (partial
aggregation), inside a salt of the digest, and over all salts. A group of copies reaches a reducer as at
most one row per map task and salt, then as one row per salt, however many copies it has. Its verdict goes out to
its rows in as many parts as the group has rows in, so no task gets all rows of a group either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import each_way, one_row_each, way_of, ways_used

WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
_STEP = "CAST(36893488147419103232 AS DECIMAL(20,0))"  # 2^65
_HALF = "CAST(9223372036854775808 AS DECIMAL(20,0))"  # 2^63


def without_white(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest_chars: int = 64
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical once ``[\\x20\\x09-\\x0D]`` is deleted. Of equal texts the one with most
    code points stays, then the smallest id. The id must be integral. ``digest_chars`` shortens the digest
    that groups meet on; results don't depend on it, as content is always compared.

    Defined cases: a null text is an empty one; a null id loses every tie and, where all ids of a group are
    null, ``keep_id`` is null and those rows are kept; rows that repeat an id share one verdict; an empty
    table gives an empty result; other columns are ignored.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"),
        without_white(F.col(text_col)).alias("_norm"),
        way_of(id_col).alias("_way"),
    ).withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256))
    # One decimal orders rows by (code points, id) and, unlike a struct, fits hash aggregation.
    rank = F.expr(
        f"CAST(_n AS DECIMAL(11,0)) * {_STEP}"
        f" + COALESCE({_HALF} - CAST(doc_id AS DECIMAL(20,0)), CAST(0 AS DECIMAL(21,0)))"
    ).cast("decimal(38,0)")
    keyed = base.select(
        F.substring("text_sha256", 1, digest_chars).alias("_key"),
        "text_sha256",
        "_norm",
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("_salt"),
        rank.alias("_rank"),
        "_way",
    )
    salted = keyed.groupBy("_key", "_salt", "text_sha256", "_norm").agg(
        F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_size"), ways_used("_way").alias("_ways")
    )
    winners = salted.groupBy("_key", "text_sha256", "_norm").agg(
        F.max("_rank").alias("_rank"), F.sum("_size").alias("group_size"), F.bit_or("_ways").alias("_ways")
    )
    rest = F.expr(f"_rank % {_STEP}")
    found = winners.select(
        "text_sha256",
        F.when(rest > 0, (F.expr(_HALF) - rest).cast("long")).alias("keep_id"),
        "group_size",
        each_way("_ways").alias("_way"),
    )
    return (
        base.select("doc_id", "text_sha256", "_way")
        .join(found, ["text_sha256", "_way"])
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        )
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one of each group, with all their columns.

    Of rows that repeat the kept id within a group, and of a group whose ids are all null, the one with most code
    points stays, then the largest by all columns in order; a row whose id was kept for another text doesn't.
    """
    groups = duplicate_groups(docs, id_col, text_col).where("kept")
    kept = groups.groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text")).agg(F.count(F.lit(1)).alias("_copies"))
    return one_row_each(docs, F.sha2(without_white(F.col(text_col)).cast("binary"), 256), id_col, text_col, kept)
