"""The allow-listed tables of a lake folder, each read only when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "employee_master", "fact_assignment_history", "fact_bank_account",
    "fact_payroll_monthly", "employee_features", "graph_components", "dim_calendar", "dim_org_unit",
    "eval_items", "subject_areas", "subject_labels", "mix_targets", "name_alias",
)


class Lake:
    """Tables of one folder, `<folder>/<table>.parquet`, a file or a folder of files.

    Only known names resolve: a folder listing never adds a table. A declared schema
    may be given per table; without it the schema in the files is used.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES, schemas: dict[str, T.StructType] | None = None):
        self.spark, self.folder, self.tables, self.schemas = spark, folder.rstrip("/"), tuple(tables), schemas or {}

    def path(self, name: str) -> str:
        if name not in self.tables:
            raise KeyError(f"{name} is not a table of this lake")
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.table(name)
        except KeyError as missing:
            raise AttributeError(str(missing)) from None

    def exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def register(self, *names: str, prefix: str = "") -> list[str]:
        """Temporary views of the given tables, or of all that exist; their names. A given table that can't be read raises."""
        kept = names or [n for n in self.tables if self.exists(n)]
        for name in kept:
            self.table(name).createOrReplaceTempView(f"{prefix}{name}")
        return [f"{prefix}{n}" for n in kept]


def isolated(spark: SparkSession, folder: str, tables: tuple[str, ...], prefix: str = "") -> Lake:
    """A lake of tables that only an evaluation may see: views of its own session, not of the caller's."""
    lake = Lake(spark.newSession(), folder, tables)
    lake.register(prefix=prefix)
    return lake
