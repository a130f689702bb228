"""Profiles of server endpoints: per feature, how many sessions lie near the mean, and their mean.

A profile row holds ``features_value``, an array of ``(frac, mean)`` in feature order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.binary import md5_bytes
from wireloom.operators.features import FEATURES
from wireloom.plans.skew import ROWS_PER_CHUNK, join_by_size
from wireloom.plans.staging import stage

#: Half-width of the kept band, in standard deviations.
BAND = 0.5

#: Relative slack of the band's edges, so that rounding never drops a value equal to the mean.
SLACK = 1e-9

TOP = 10


def features_long(df: DataFrame, *keys: str) -> DataFrame:
    """Name/value arrays to one row per feature: ``keys, pos, name, value``."""
    pairs = F.arrays_zip(
        F.col("features_name").alias("name"), F.col("features_value").alias("value")
    )
    exploded = df.select(*keys, F.posexplode(pairs).alias("pos", "pair"))
    return exploded.select(*keys, "pos", "pair.name", "pair.value")


def features_arrays(df: DataFrame, *keys: str) -> DataFrame:
    """The reverse of ``features_long``; a group has one row per feature, so it stays small."""
    entry = F.sort_array(F.collect_list(F.struct("pos", "name", "value")))
    return (
        df.groupBy(*keys)
        .agg(entry.alias("entries"))
        .select(
            *keys,
            F.col("entries.name").alias("features_name"),
            F.col("entries.value").alias("features_value"),
        )
    )


def feature_columns(df: DataFrame, *keys: str) -> DataFrame:
    """Per-feature totals of a group (``n``, ``total``): the group's value arrays by column."""
    return (
        features_long(df, *keys)
        .groupBy(*keys, "pos", "name")
        .agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    )


def profile_features(
    sessions: DataFrame, key: str = "m", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Long profile: per endpoint and feature ``(frac, mean)``; a null mean when none is kept.

    Pass 1 aggregates mean and deviation with map-side combine.  Pass 2 brings them back to the
    sessions (those of the endpoints with most sessions are joined by broadcast, see ``join_by_size``) and
    aggregates the kept values, again combined before the shuffle.
    """
    sessions = sessions.select(key, "features_value")
    value = F.col("value")
    values = sessions.select(key, F.posexplode("features_value").alias("pos", "value"))
    moments = (
        values.groupBy(key, "pos")
        .agg(F.count(value).alias("n"), F.avg(value).alias("avg"), F.stddev_pop(value).alias("dev"))
        .groupBy(key)
        .agg(
            F.max("n").alias("n"),
            # One entry per feature.
            F.sort_array(F.collect_list(F.struct("pos", "avg", "dev"))).alias("moments"),
        )
    )
    joined = join_by_size(sessions, stage(moments, "moments"), [key], "n", rows_per_chunk)
    pairs = F.arrays_zip(
        F.col("features_value").alias("value"),
        F.col("moments.avg").alias("avg"),
        F.col("moments.dev").alias("dev"),
    )
    slack = SLACK * F.greatest(F.abs("avg"), F.lit(1.0))
    kept = F.abs(value - F.col("avg")) <= BAND * F.col("dev") + slack
    return (
        joined.select(key, "n", F.posexplode(pairs).alias("pos", "pair"))
        .select(key, "n", "pos", "pair.*")
        .groupBy(key, "pos")
        .agg(
            F.max("n").alias("n"),
            F.count(F.when(kept, value)).alias("kept"),
            F.avg(F.when(kept, value)).alias("mean"),
        )
        .select(
            key,
            "pos",
            F.element_at(F.array(*[F.lit(name) for name in FEATURES]), F.col("pos") + 1).alias(
                "name"
            ),
            (F.col("kept") / F.col("n")).alias("frac"),
            "mean",
        )
    )


def profiles(
    sessions: DataFrame, key: str = "m", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """The profile table: ``rowkey = md5(m)``, the endpoint, names and ``(frac, mean)`` values."""
    long = profile_features(sessions, key, rows_per_chunk)
    pair = F.struct("frac", "mean").alias("value")
    return features_arrays(long.select(key, "pos", "name", pair), key).select(
        md5_bytes(F.col(key).cast("binary")).alias("rowkey"), key, "features_name", "features_value"
    )


def profiles_wide(profile_table: DataFrame) -> DataFrame:
    """One ``(frac, mean)`` column per feature."""
    columns = [F.col("features_value")[i].alias(name) for i, name in enumerate(FEATURES)]
    others = [c for c in profile_table.columns if not c.startswith("features_")]
    return profile_table.select(*others, *columns)


def top_features(values: Column, names: Column, top: int = TOP) -> Column:
    """The ``top`` features by share, equal shares by later position first; no shuffle needed."""
    ranked = F.transform(
        values,
        lambda v, i: F.struct(
            v["frac"].alias("frac"),
            i.alias("pos"),
            F.element_at(names, i + 1).alias("name"),
            v["mean"].alias("mean"),
        ),
    )
    return F.slice(F.sort_array(ranked, asc=False), 1, top)


def top_features_long(profile_table: DataFrame, *keys: str, top: int = TOP) -> DataFrame:
    """``top_features`` as rows ``keys, rank, pos, name, frac, mean`` (rank from 1)."""
    best = top_features(F.col("features_value"), F.col("features_name"), top)
    return (
        profile_table.select(*keys, F.posexplode(best).alias("place", "feature"))
        .select(*keys, (F.col("place") + 1).alias("rank"), "feature.*")
        .select(*keys, "rank", "pos", "name", "frac", "mean")
    )
