"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source, its documents in a seeded order, are cut into equal blocks. Blocks are apportioned to
sources, and a source's blocks to its shards, by highest quotients; each shard then selects its integer quota
of blocks by a seeded permutation, whole passes first.
"""

from __future__ import annotations

import heapq
import itertools
import math
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.llm.common import shared_dir, ship

#: Weights by place among the sources, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
MAX_SOURCES = 100_000
#: Documents of more words may be given in part; packing cuts them in any case.
LONG = 1024
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Shards whose quotas are settled together by one task.
TOGETHER = 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``limit`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            open_.discard(i)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), at most ``caps``; ties go to the earlier entry.

    All quotients above a threshold are granted at once (found by bisection), the last few one by one.
    """
    def granted(t: float) -> list[int]:
        return [min(c, max(0, math.ceil((w / t - 1) / 2))) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]

    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    if seats <= 0:
        return [0] * len(weights)
    low, high = 0.0, max(weights) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or sum(granted(mid)) > seats:
            low = mid
        else:
            high = mid
    out = granted(high)
    heap = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, out, caps, strict=True)) if w > 0 and n < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def block_choice(blocks: int, quota: int, *seed: int) -> tuple[int, int, int, int]:
    """(passes, rest, step, shift): a shard's blocks are taken ``passes`` times, and once more those among ``blocks``
    that ``(step * block + shift) % blocks`` puts below ``rest``.

    Step and shift are drawn by the seed; the step has no common divisor with the blocks and lies in the middle half
    of their number, as steps near either end would choose runs of neighbours.
    """
    blocks = max(1, blocks)
    rng = random.Random(",".join(map(str, seed)))
    step = blocks // 4 + rng.randrange(blocks // 2 + 1)
    while math.gcd(step, blocks) != 1:
        step += 1
    return quota // blocks, quota % blocks, step, rng.randrange(blocks)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    block_words: int = 16,
    shard_words: int = 1 << 16,
    seed: int = 7,
    together: int = TOGETHER,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, source, shard``.

    Sources in code point order, null last, weigh ``weights`` repeating; their targets share all words, none
    above 3 times its source. ``taken`` is the number of a document's words that the mix takes, repeats
    counted: 0 to 3 times its size. Runs agree: order and selection hang on ids and ``seed`` only.

    A source has a shard for each ``shard_words`` words, however large it is. Blocks go by highest quotients to
    sources, then to groups of about ``together`` shards, on the driver; the shards of a group get theirs in a task
    of their own, and quotas reach the documents by a join.

    Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own; a very long text is
    one document of one shard; repeated rows take part one by one, a null id is ordered like any other; an empty table
    gives an empty result; other columns are ignored. The driver gets a row for each source, at most MAX_SOURCES, else
    an error, and for each group of shards: one for ``together * shard_words`` words.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_dir(spark)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    ).checkpoint()
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r.source, int(r.n or 0)) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in totals]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))])
    plan = [(s, i, n, t, max(1, math.ceil(n / shard_words))) for i, ((s, n), t) in enumerate(zip(totals, goal, strict=True))]
    by_source = spark.createDataFrame([(*p, -(-p[4] // together)) for p in plan], "source string, _i int, source_size long, target double, _shards long, _groups long")
    # Sources are MAX_SOURCES at most.
    placed = sized.join(F.broadcast(by_source), sized.source.eqNullSafe(by_source.source)).select(
        "doc_id",
        sized.source,
        "_i",
        "_groups",
        "size",
        "source_size",
        "target",
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("_order"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), F.col("_shards")).alias("shard"),
    )
    shards = placed.groupBy("_i", "shard", F.pmod("shard", "_groups").alias("_group")).agg(F.sum("size").alias("_words"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_words") / block_words))
    groups = sorted((r._i, r._group, int(r.n), int(r.b)) for r in shards.groupBy("_i", "_group").agg(F.sum("_words").alias("n"), F.sum("_blocks").alias("b")).collect())
    members: list[list[tuple[int, int, int, int]]] = [[] for _ in plan]
    for g in groups:
        members[g[0]].append(g)
    per_source = [sum(b for *_, b in m) for m in members]
    seats = min(round(sum(sizes) / block_words), LIMIT * sum(per_source))
    quotas: list[tuple[int, int, int]] = []
    for i, q in enumerate(sainte_lague(goal, seats, [LIMIT * b for b in per_source])):
        if abs(goal[i] - LIMIT * sizes[i]) < 1e-6 * max(1, sizes[i]):
            q = LIMIT * per_source[i]  # a target at its limit is met exactly, the last, shorter blocks included
        split = sainte_lague([float(n) for _, _, n, _ in members[i]], q, [LIMIT * b for *_, b in members[i]])
        quotas += [(i, g, n) for (_, g, _, _), n in zip(members[i], split, strict=True)]
    quota = spark.createDataFrame(quotas, "_i int, _group long, _seats long")

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard", ignore_index=True)
        blocks = [int(b) for b in part["_blocks"]]
        split = sainte_lague([float(n) for n in part["_words"]], int(part["_seats"].iloc[0]), [LIMIT * b for b in blocks])
        told = [(int(i), int(s), max(1, b), *block_choice(b, q, seed, i, s)) for i, s, b, q in zip(part["_i"], part["shard"], blocks, split, strict=True)]
        return pd.DataFrame(told, columns=["_i", "shard", "_blocks", "_passes", "_rest", "_a", "_b"])

    chosen = shards.join(quota, ["_i", "_group"]).groupBy("_i", "_group").applyInPandas(settle, "_i int, shard long, _blocks long, _passes long, _rest long, _a long, _b long")
    start = F.sum("size").over(
        Window.partitionBy("_i", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    taken = F.expr(f"""
        CASE WHEN size = 0 THEN 0L ELSE _passes * size + IF(_rest = 0, 0L,
          aggregate(sequence(_start DIV {block_words}, (_start + size - 1) DIV {block_words}), 0L,
            (acc, b) -> acc + IF((_a * b + _b) % _blocks < _rest,
               least(_start + size, (b + 1) * {block_words}) - greatest(_start, b * {block_words}), 0L))) END""")
    return (
        placed.withColumn("_start", start)
        .join(chosen, ["_i", "shard"])
        .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard")
    )


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """A text up to the end of its n-th word; null stays null."""

    def cut(t, k):
        if t is None:
            return None
        end = 0
        for word in itertools.islice(_WORD.finditer(t), int(k)):
            end = word.end()
        return t[:end]

    return pd.Series([cut(t, k) for t, k in zip(text, n, strict=True)], dtype=object)


def given(mixed: DataFrame, long_words: int = LONG) -> DataFrame:
    """``_id, _source, _size, _times, _cut``: how often a document stands whole, and how many first words once more.

    In a shard, largest documents first, what rounding to whole documents leaves owed or given too much goes on to
    the next, so at its end the words differ from its quota by half a document of ``long_words`` at most. Longer
    documents give exactly the words taken from them, the last of their copies cut. A document taken whole or not
    at all stays so. Rows that share id, source and size are given alike.
    """
    units = mixed.groupBy("source", "shard", F.col("doc_id").cast("string").alias("_id"), F.col("size").alias("_size")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("taken").alias("_taken")
    )

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_size", "_id"], ascending=[False, True], ignore_index=True)
        times, cuts, owed = [], [], 0
        for size, rows, taken in zip(part["_size"].tolist(), part["_rows"].tolist(), part["_taken"].tolist(), strict=True):
            whole, rest = divmod(taken, rows * size)
            cut = rest // rows if size > long_words else 0
            owed += rest - cut * rows
            if rest and not cut and 2 * owed >= rows * size:
                whole, owed = whole + 1, owed - rows * size
            times.append(whole)
            cuts.append(cut)
        return pd.DataFrame({"_id": part["_id"], "_source": part["source"], "_size": part["_size"], "_times": times, "_cut": cuts})

    done = units.where("_taken > 0").groupBy("source", "shard").applyInPandas(settle, "_id string, _source string, _size long, _times int, _cut int")
    return done.where("_times > 0 OR _cut > 0")
