"""Relations by (schema, object): registered DataFrames, files, JDBC tables, or the session's own tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from granary.functions.catalog import spark_type
from granary.functions.expressions import to_spark

class Relations:
    """Resolves names without case. What isn't registered is looked up as ``schema.object`` in the session's catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[tuple[str, str], DataFrame] = {}

    def register(self, schema: str, name: str, df: DataFrame) -> None:
        self._known[schema.upper(), name.upper()] = df

    def register_files(self, schema: str, name: str, path: str, fmt: str = "parquet", **options) -> None:
        self.register(schema, name, self.spark.read.format(fmt).options(**options).load(path))

    def register_folder(self, schema: str, folder: str, names: list[str], fmt: str = "parquet") -> None:
        """One relation for each ``folder/name.fmt``."""
        for name in names:
            self.register_files(schema, name, f"{folder}/{name}.{fmt}", fmt)

    def store(self, schema: str, name: str, df: DataFrame, path: str | None = None) -> str:
        """Write a relation, an aggregate for example, as Parquet and register what was written; its path.

        Without a path it goes to the folder of ``spark.checkpoint.dir``, which the driver and all executors share.
        """
        if path is None:
            shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getCheckpointDir()
            if not shared and not self.spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip(os.sep)}/granary-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.register_files(schema, name, path)
        return path

    def register_function(self, schema: str, name: str, parameters: dict[str, str], returns: str, body: str) -> None:
        """A scalar function that expressions may call as ``schema.name(...)``, in the session's catalog.

        Parameters are names with types; the body is an expression over them, which Catalyst puts in place of a call.
        Functions of other kinds made with CREATE FUNCTION in that schema are called alike.
        """
        quoted = [f"`{part.replace('`', '``')}`" for part in (schema, name)]
        told = ", ".join(f"{p} {spark_type(t)}" for p, t in parameters.items())
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted[0]}")
        self.spark.sql(f"CREATE OR REPLACE FUNCTION {'.'.join(quoted)}({told}) RETURNS {spark_type(returns)} RETURN {to_spark(body, returns)}")

    def find(self, schema: str, name: str) -> DataFrame | None:
        key = schema.upper(), name.upper()
        if key not in self._known:
            try:
                self._known[key] = self.spark.table(f"`{schema}`.`{name}`")
            except AnalysisException:
                return None
        return self._known[key]

    def __call__(self, schema: str, name: str) -> DataFrame:
        df = self.find(schema, name)
        if df is None:
            raise LookupError(f"no relation {schema}.{name}")
        return df

    def columns(self, schema: str, name: str) -> frozenset[str] | None:
        df = self.find(schema, name)
        return None if df is None else frozenset(c.upper() for c in df.columns)

    def types(self, schema: str, name: str) -> dict[str, str]:
        df = self.find(schema, name)
        return {} if df is None else {f.name.upper(): f.dataType.simpleString() for f in df.schema.fields}
