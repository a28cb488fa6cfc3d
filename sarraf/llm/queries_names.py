"""The query of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarraf.functions.keys import bare_code, norm_id
from sarraf.llm import components, names
from sarraf.session import cut
from sarraf.sources.catalog import Lake


def _people(lake: Lake) -> DataFrame:
    kinds = {"p": "passport_no", "n": "national_id", "i": "iqama_no"}
    born = F.concat(F.lit("d:"), F.date_format("dob", "yyyy-MM-dd")).alias("born")
    # Step by step, so that no pattern is gone through twice for a row.
    rows = lake.employee_master.select(norm_id("employee_id").alias("id"), "name_en", "name_ar", born, *[bare_code(c).alias(k) for k, c in kinds.items()])
    rows = rows.select("*", *[F.regexp_replace(k, "[^0-9]", "").alias(f"{k}_digits") for k in kinds])
    numbers = [F.concat(F.lit(f"{k}:"), names.usable_number(F.col(k), F.col(f"{k}_digits"))) for k in kinds]
    return rows.select("id", "name_en", "name_ar", F.array_compact(F.array("born", *numbers)).alias("keys"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of different ids of one person."""
    lake = Lake(spark, folder)
    links = cut(names.link_names(_people(lake), names.read_aliases(lake.name_alias)))
    ties = links.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.concat_ws(" ", "a", "b").alias("tie")), F.struct(F.col("b").alias("id"), F.concat_ws(" ", "a", "b").alias("tie")))))
    people = cut(components.connected_groups(ties, "id", "tie"))
    return names.group_pairs(people, "id", "group_id").select(F.col("a").alias("employee_id_a"), F.col("b").alias("employee_id_b"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
