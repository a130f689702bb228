"""Protocol models: match profiles to models, open new models, identify sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.matching import (
    RATIO_HIGH_TRAINING,
    RATIO_LOW,
    Band,
    first_match,
    profile_means,
    reference_table,
)
from wireloom.plans.numbering import number_by_hash
from wireloom.plans.staging import stage

TRAINING = Band(RATIO_LOW, RATIO_HIGH_TRAINING, probe_on_top=True)
IDENTIFY = Band(probe_on_top=False)


def model_id(number: Column) -> Column:
    return F.format_string("WX%03d", number)


def match_profiles(profile_table: DataFrame, models: DataFrame) -> DataFrame:
    """``rowkey, id``: every profile with the first matching model's id, or null.

    The ratio is profile mean over model mean on the model's ten top features.
    """
    probes = profile_table.select(
        F.col("rowkey").alias("probe"), profile_means(F.col("features_value")).alias("means")
    )
    found = first_match(probes, reference_table(models, "id"), TRAINING)
    return found.select(F.col("probe").alias("rowkey"), F.col("ref").alias("id"))


def new_assignments(profile_table: DataFrame, matched: DataFrame, models: DataFrame) -> DataFrame:
    """Unmatched profiles with ids that continue after the highest existing number."""
    unmatched = matched.where(F.col("id").isNull()).select("rowkey")
    numbered = number_by_hash(
        unmatched.withColumn("digest", F.hex("rowkey")), "digest", "place"
    ).drop("digest")
    highest = models.agg(
        F.coalesce(F.max(F.substring("id", 3, 18).cast("bigint")) + 1, F.lit(0)).alias("next")
    )
    number = F.col("place") + highest.scalar()
    return numbered.select("rowkey", model_id(number).alias("id"))


def union_assignments(new: DataFrame, matched: DataFrame) -> DataFrame:
    """New and matched ``(rowkey, id)`` in one table."""
    return new.unionByName(matched.where(F.col("id").isNotNull()))


def train_models(profile_table: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assignments ``(rowkey, id)`` of all profiles, and the models they use, new ones included."""
    matched = stage(match_profiles(profile_table, models), "matched")
    new = new_assignments(profile_table, matched, models)
    assigned = union_assignments(new, matched)
    opened = new.join(profile_table, "rowkey").select(
        "id", "features_name", "features_value", F.lit(None).cast("string").alias("keywords")
    )
    used = models.join(matched.select("id").distinct(), "id", "left_semi").select(*opened.columns)
    return assigned, opened.unionByName(used)


def identify_sessions(sessions: DataFrame, models: DataFrame) -> DataFrame:
    """``rowkey, id``: the first model that fits each session, or null.

    The ratio is model mean over session value on the model's ten top features.  To identify one
    session, filter the table by ``rowkey`` first: the filter reaches the scan.
    """
    probes = sessions.select(
        F.col("rowkey").alias("probe"), F.col("features_value").alias("means")
    )
    found = first_match(probes, reference_table(models, "id"), IDENTIFY)
    return found.select(F.col("probe").alias("rowkey"), F.col("ref").alias("id"))
