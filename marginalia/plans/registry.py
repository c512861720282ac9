"""Registration of catalog queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The driver tables of one folder, as DataFrames or in a SQL text."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` over all partitions, for work that is heavy beside the bytes of its file."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


@dataclass
class Catalog:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
