"""The queries of problems 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarraf.functions.keys import norm_word
from sarraf.llm import leakage, mixing, subjects
from sarraf.sources.catalog import Lake


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents holding passages of evaluation items that carry at least half of an item's words."""
    lake = Lake(spark, folder)
    return leakage.find_leaks(lake.documents, "doc_id", "text", lake.eval_items, "item_id", "text").select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subject areas that at least one paragraph of a document is about."""
    lake = Lake(spark, folder)
    rows = subjects.subject_areas(lake.documents, "doc_id", "text", lake.subject_labels, "doc_id", "subject_code", lake.eval_items, "text")
    return rows.select("doc_id", F.col("subject").alias("subject_code"))


def _mixture(lake: Lake) -> mixing.Mixture:
    def plain(c: str):
        return F.replace(norm_word(c), F.lit("-"), F.lit("_"))

    targets = lake.mix_targets.select(plain("source").alias("s"), "target_share", "max_repeats").where("s is not null").groupBy("s").agg(F.sum("target_share"), F.max("max_repeats"))
    wanted = [(r[0], float(r[1]), int(r[2])) for r in targets.orderBy("s").collect()]  # a small table, one row a source
    counts = mixing.token_counts(lake.documents, "doc_id", "text", plain("source"), f"{mixing.tokenizer_folder(lake.spark)}/byte_bpe_multi_50k.tiktoken")
    return mixing.mix(counts, wanted)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of a document drawn into the mixture, with its shard, slot and pass."""
    rows = _mixture(Lake(spark, folder)).pieces
    return rows.select("shard", "slot", "source", "pass", "block", F.col("doc").alias("doc_id"), "from_token", F.col("n").alias("tokens"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources in the mixture."""
    return mixing.shares(_mixture(Lake(spark, folder)))


QUERIES = {f.__name__: f for f in (p8_found, p9_mix, p9_shares, p10_found)}
SQL: dict[str, str] = {}
