"""The store's tables as Parquet folders: versions are written beside each other and named in a small ledger.

A version is complete or absent: the ledger row that names it is written after its files. Readers take the newest
version that the ledger names, so a run that dies leaves the old one in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, conformed

LEDGER = "table string, version long, path string"


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _ledger(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_ledger")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/_ledger") if there else self.spark.createDataFrame([], LEDGER)

    def _newest(self, table: str) -> tuple[int, str | None]:
        row = self._ledger().filter(F.col("table") == table).agg(F.max(F.struct("version", "path")).alias("v")).first()["v"]
        return (row["version"], row["path"]) if row else (0, None)

    def read(self, table: str) -> DataFrame:
        """The newest version, or an empty table of the fixed schema."""
        _, path = self._newest(table)
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame) -> None:
        """A new version of the table."""
        version = self._newest(table)[0] + 1
        path = f"{self.root}/{table}/v{version}"
        conformed(rows, table).write.mode("overwrite").parquet(path)  # a version that the ledger does not name was never finished
        self.spark.createDataFrame([(table, version, path)], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/_ledger")
