"""Session helpers: a local builder for tests and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "sarraf", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SARRAF_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session without one gets its own.

    On a cluster tables in a machine-local folder could not be read back by other executors,
    so without a shared folder this raises.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sarraf-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[str] = []


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the tables `cut` has written in this process; frames that read them can't be used any more."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count


def drop(*tables: DataFrame | None) -> None:
    """Delete the tables behind frames returned by `cut`, as soon as what is made of them is written; None is passed over."""
    for table in tables:
        where = getattr(table, "_cut_path", None)
        if where in _written:
            _written.remove(where)
            _delete(table.sparkSession, where)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through a table written to the shared checkpoint folder.

    The table survives lost executors, is columnar and compressed, and a later plan reads
    only the columns it needs of it; unlike a checkpointed plan it carries no constraints
    over, which iterative plans would pile up. Loops `drop` a round's table once the next one
    is written; `release` deletes the rest when results that read them are written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def cut_counting(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """`cut`, and how many rows were written (of those that meet `condition`), counted while they are."""
    seen = Observation()
    table = cut(df.observe(seen, (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")))
    return table, seen.get["n"]
