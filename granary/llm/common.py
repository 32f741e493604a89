"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_SHIPPED: set[str] = set()
_REMEMBERED: dict[str, Callable[[], None]] = {}
_WORKED: list[str] = []  # the operator of this worker's last task


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` clears what an operator remembers in a worker from task to task."""
    _REMEMBERED[operator] = forget


def working(operator: str) -> None:
    """Called as a task of ``operator`` begins: what others remember goes, as a worker lives on from one to the next.

    After another operator's task the free memory goes back to the system too, which malloc else keeps.
    """
    import pyarrow

    for other, forget in _REMEMBERED.items():
        if other != operator:
            forget()
    pyarrow.default_memory_pool().release_unused()
    if _WORKED != [operator]:
        _WORKED[:] = [operator]
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


def ship(spark: SparkSession) -> None:
    """Make this package importable by a session's Python workers, once per application, and keep their batches small.

    A worker holds a batch several times over, as Arrow, pandas and Python objects; texts may be long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"granary_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` where the session has it, else one set here for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends, lost executors lose nothing."""
    return _write(df, name)[0]


class Scratch:
    """Tables written to the shared folder that go when the block ends; ``drop`` lets one go before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in self.paths.values()])


def one_row_each(docs: DataFrame, own: Column, id_col: str, text_col: str, kept: DataFrame) -> DataFrame:
    """For each row of ``kept`` (``_kept_id, _kept_text, _copies``), one row of ``docs`` with its id and text key ``own``.

    Of several rows the one with most code points stays, then the largest by all columns in order. The rows travel
    as one struct, so that no column of ``docs`` meets a name used here.
    """
    kept = written(kept, "kept")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast(kept.schema["_kept_id"].dataType).alias("id"),
        own.alias("text"),
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("n"),
    )
    same = F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("text") == F.col("_kept_text"))
    single = rows.join(kept.where("_copies = 1"), same, "left_semi").select("row.*")
    if kept.where("_copies > 1").isEmpty():
        return single
    best = F.max(F.struct("n", "row")).alias("best")
    several = rows.join(kept.where("_copies > 1"), same).groupBy("_kept_text", "_kept_id").agg(best)
    return single.union(several.select("best.row.*"))


WAYS = 64  # bits of a long


def way_of(id_col: str) -> Column:
    """Which of WAYS parts of its group a row is, by the hash of its id."""
    return F.pmod(F.xxhash64(F.lit("way"), F.col(id_col)), F.lit(WAYS)).cast("int")


def ways_used(way: str) -> Column:
    """Aggregate: the parts that a group has rows in, as bits of a long."""
    return F.bit_or(F.expr(f"shiftleft(1L, {way})"))


def each_way(ways: str) -> Column:
    """One row for each part in use, so that the rows of a large group meet their one verdict in up to WAYS tasks."""
    return F.explode(F.expr(f"filter(sequence(0, {WAYS - 1}), way -> shiftright({ways}, way) & 1L = 1L)"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(id_column: str, folds: int):
    """Row's fold: crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds
