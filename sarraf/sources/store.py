"""Writing and rebuilding tables: month partitions, signatures, edits, id registries, cached stages."""

from __future__ import annotations

import hashlib
import json
import resource
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_period(rows: DataFrame, path: str, period: str = "period", rows_per_file: int = 5_000_000, replace: bool = True, files_per_period: int | None = None) -> None:
    """Write month partitions; the month stays a column of the files. With `replace`, only the months in `rows` are replaced.

    Rows of one month are first spread by hash over `files_per_period` tasks, or else over as
    many as AQE finds right for its size, so a large month has several files.
    """
    spread = rows.withColumn("period_part", F.col(period))
    if files_per_period is None:
        spread = spread.hint("rebalance", "period_part")
    else:
        spread = spread.repartition("period_part", F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_period)))
    writer = spread.write.partitionBy("period_part").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic" if replace else "static").parquet(path)


def read_by_period(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Read month partitions; the bounds prune folders."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("period_part") >= first)
    if last is not None:
        rows = rows.where(F.col("period_part") <= last)
    return rows.drop("period_part")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def signatures(spark: SparkSession, path: str) -> dict[str, str]:
    """A signature of every folder below `path` that holds files: names, sizes and times of its files."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return {}
    found: dict[str, list[str]] = {}
    files = fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            found.setdefault(f.getPath().getParent().getName(), []).append(f"{name}|{f.getLen()}|{f.getModificationTime()}")
    return {folder: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest() for folder, names in found.items()}


def stale(now: dict[str, str], before: dict[str, str], whole_now: str = "", whole_before: str = "") -> list[str]:
    """The folders to rebuild: new or changed ones, or all if the signature of what concerns all has changed."""
    return sorted(now if whole_now != whole_before else (k for k, v in now.items() if before.get(k) != v))


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    where, fs = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def cached_stage(spark: SparkSession, folder: str, name: str, inputs: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage, built only if the digest of its inputs has changed."""
    key = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()
    manifest = f"{folder}/{name}.json"
    if read_json(spark, manifest).get("key") != key:
        build().write.mode("overwrite").parquet(f"{folder}/{name}")
        write_json(spark, manifest, {"key": key})
    return spark.read.parquet(f"{folder}/{name}")


def merge_edits(rows: DataFrame, keys: list[str], dropped: DataFrame | None = None, patches: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """Rows without the dropped keys, with the patched cells (nulls patch nothing), and with the added rows."""
    if dropped is not None:
        rows = rows.join(dropped.select(*keys).distinct(), keys, "left_anti")
    if patches is not None:
        cells = [c for c in patches.columns if c not in keys]
        renamed = patches.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in cells])
        rows = rows.join(renamed, keys, "left").select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in cells else F.col(c) for c in rows.columns])
    return rows if added is None else rows.unionByName(added, allowMissingColumns=True)


def register_ids(known: DataFrame, keys: DataFrame, columns: list[str], prefix: str = "ALT-") -> DataFrame:
    """The registry `columns`, `number`, `id` with new keys numbered on from the last, in the order of the keys."""
    from sarraf.operators.windows import global_rank

    new = keys.select(*columns).distinct().join(known.select(*columns), columns, "left_anti")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0)).cast("long").alias("_last"))
    numbered = global_rank(new, [F.col(c) for c in columns], "_n").crossJoin(F.broadcast(last))
    fresh = numbered.select(*columns, (F.col("_n") + F.col("_last")).alias("number"))
    return known.select(*columns, "number", "id").unionByName(fresh.withColumn("id", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), 6, "0"))))


def row_digest(rows: DataFrame) -> str:
    """A digest of a table that does not depend on the order of its rows; equal tables have equal digests."""
    hashed = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).alias("h"))
    r = hashed.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(f"{r['n']}|{r['s']}|{r['x']}".encode()).hexdigest()


def keyed_copy(rows: DataFrame, path: str, key: str) -> DataFrame:
    """A copy of `rows` ordered by `key` over range partitions: a look-up of few keys reads few row groups, as with an index."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def apply_versions(current: DataFrame, changes: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(table after the changes, rejected changes): a change holds only if it was made against the version that is current.

    `current` has `key`, `value`, `version`; `changes` has `key`, `value`, `based_on`. Of several
    changes of one key on one version the smallest value counts, the others are rejected.
    """
    one = changes.groupBy(key, "based_on").agg(F.min(value).alias("_new"))
    marked = current.join(one.withColumnRenamed("based_on", "version"), [key, "version"], "left")
    taken = F.col("_new").isNotNull()
    after = marked.select(key, F.when(taken, F.col("_new")).otherwise(F.col(value)).alias(value), (F.col("version") + taken.cast("int")).alias("version"))
    first = marked.where(taken).select(key, F.col("version").alias("based_on"), F.col("_new").alias(value))
    return after, changes.select(key, "based_on", value).exceptAll(first)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables as Markdown; each shows at most `most` rows and says if there are more."""
    lines = [f"# {title}"]
    for name, rows in tables.items():
        found = rows.limit(most + 1).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found[:most]]
        if len(found) > most:
            lines.append(f"(the first {most} rows)")
    return "\n".join(lines) + "\n"


class Profile:
    """Seconds and peak memory of the driver's process by stage, merged into a manifest: `with profile.stage("features"): ...`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stages = spark, path, {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            took = time.monotonic() - began
            before = self.stages.get(name, {"seconds": 0.0, "runs": 0})
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            self.stages[name] = {"seconds": round(before["seconds"] + took, 3), "runs": before["runs"] + 1, "peak_mb": peak}

    def merge(self) -> dict:
        """Write the stages over those of earlier runs that have the same names; the merged manifest."""
        merged = read_json(self.spark, self.path) | self.stages
        write_json(self.spark, self.path, merged)
        return merged
