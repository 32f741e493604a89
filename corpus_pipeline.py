"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and reads it again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import exact_dedup, mixing, near_dup, packing, toxicity
from granary.llm.common import documents, fold_of, written
from granary.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it is trained on the labels of documents outside fold 2.

    Each row is judged by its text alone: repeated rows and null ids one by one, very long texts on the whole, a null
    or empty text by the rate of texts without a clause. An empty table stays empty; other columns, whatever their
    names, come back unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = fold_of("doc_id", 4)
    return toxicity.drop_toxic(docs, toxicity.train(docs.where(fold != 2), labels.where(fold != 2)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space stays: most code points, then smallest id.

    A null text is an empty one; texts count whole; a null id loses every tie; of rows that repeat the kept id the
    largest by all columns stays. An empty table stays empty; other columns, whatever their names, come back unchanged.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts 0.8 alike in their five-word shingles stays: that of the smallest id.

    A null text is an empty one; texts count whole; a null id is larger than any; of rows that repeat the kept id the
    largest by all columns stays. An empty table stays empty; other columns, whatever their names, come back unchanged.
    """
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, as often as it takes them.

    A document stands 0 to 3 times. Those of up to ``mixing.LONG`` words stay whole, and what that gives too much or
    too little is made up for by others of the shard; of a longer one the last copy is cut to the words still taken.
    So the words of each shard, and of each source, come to their quota but for half such a document a shard.

    A null or empty text has no words, so it goes; a null source is a source of its own, a null id like any other;
    rows that share id, source and size are given alike. An empty table stays empty; other columns, whatever their
    names, come back unchanged (``text`` and ``n_chars`` of a cut copy are those of the cut).
    """
    given = mixing.given(mixing.mix(docs))
    # A row travels as one struct, so that none of its columns meets a name used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").cast("string").alias("from"),
        mixing.word_count(F.col("text")).alias("words"),
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("from").eqNullSafe(F.col("_source")) & (F.col("words") == F.col("_size"))
    found = rows.join(given, same)
    cut = F.when(F.col("_cut") > 0, F.array("_cut")).otherwise(F.array().cast("array<int>"))
    found = found.select("row", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("_times")), cut)).alias("first"))
    found = found.withColumn("part", mixing.first_words(F.when(F.col("first") > 0, F.col("row.text")), F.col("first")))
    new = {"text": F.coalesce("part", "row.text"), "n_chars": F.when(F.col("first") > 0, F.length("part").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, as ``packing.pack`` states.

    A null or empty text is a document of the end token alone; a very long one gives all its pieces; repeated rows and
    null ids are packed one by one; an empty table gives an empty result; other columns are ignored.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores, signatures and a tokenizer's ids aren't expressible in SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
