"""Findings and bundles with a declared schema: assembled as structs, checked before they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: The columns of a finding, alike for every layer.
FINDING = _schema("employee_id s, code s, layer s, severity s, period_from i, period_to i, months l, impact_monthly d, impact_cumulative d, description s, evidence s")
#: The columns of a dismissal.
DISMISSAL = _schema("employee_id s, code s, fingerprint s, runs_since i, impact d, disposition_id s")


def conform(rows: DataFrame, declared: T.StructType) -> DataFrame:
    """`rows` in the columns, order and types declared; a column without a source is null, one too many is an error."""
    extra = sorted(set(rows.columns) - set(declared.fieldNames()))
    if extra:
        raise ValueError(f"columns not declared: {extra}")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared])


def read_conforming(spark, path: str, declared: T.StructType) -> DataFrame:
    """The table at `path` in the declared schema; a missing table is an empty one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], declared)
    return conform(spark.read.parquet(path), declared)


def faults(required: dict[str, Column], enums: dict[str, tuple[Column, list[str]]] | None = None) -> Column:
    """What a bundle lacks or has outside its enumeration, as an array of texts."""
    told = [F.when(c.isNull(), f"{n} is missing") for n, c in required.items()]
    told += [F.when(c.isNotNull() & ~c.isin(*allowed), F.concat(F.lit(f"{n} is "), c)) for n, (c, allowed) in (enums or {}).items()]
    return F.array_compact(F.array(*told))


def checked(bundle: Column, wrong: Column) -> Column:
    """The bundle, or an error that names what is wrong with it: a faulty bundle never leaves."""
    return F.when(F.size(wrong) == 0, bundle).otherwise(F.raise_error(F.concat(F.lit("bundle: "), F.array_join(wrong, ", "))).cast("string"))
