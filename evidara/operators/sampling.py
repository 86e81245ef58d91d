"""Deterministic samples, orders and schedules."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.ranks import placed


def hash_sample(df: DataFrame, identifier: str, prefix: str, n: int = 64) -> DataFrame:
    """The n distinct ids of lowest sha256('prefix:id'), with that digest."""
    digest = F.sha2(F.concat(F.lit(f"{prefix}:"), F.col(identifier).cast("string")).cast("binary"), 256)
    return df.select(identifier).distinct().withColumn("digest", digest).orderBy("digest", identifier).limit(n)


def band(position: Column, n: Column, bands: int = 5) -> Column:
    """1-based band of a 0-based position: min(bands, position * bands div n + 1).  Unlike ntile for remainders."""
    return F.least(F.lit(bands), F.floor(position * bands / n) + 1).cast("int")


def banded(df: DataFrame, value: str, identifier: str, *by: str, bands: int = 5) -> DataFrame:
    """Adds the band of each row in the order (value, identifier) of its group."""
    return placed(df, [value, identifier], *by).withColumn("band", band(F.col("place"), F.col("placed_of"), bands)).drop("place", "placed_of")


def stratified_audit(df: DataFrame, per_band: int = 5) -> DataFrame:
    """Audit rows of (candidate_id, gold, predicted, margin).

    All errors on decisive gold labels (band 0), and of the neutral rows
    predicted otherwise the first ``per_band`` ids of each margin quintile.
    """
    stratum = F.concat_ws("-to-", "gold", "predicted").alias("stratum")
    decisive = df.filter("gold <> 'neutral' AND gold <> predicted").select("candidate_id", stratum, F.lit(0).alias("band"))
    neutral = banded(df.filter("gold = 'neutral' AND predicted <> 'neutral'"), "margin", "candidate_id", "predicted")
    picked = placed(neutral, ["candidate_id"], "predicted", "band").filter(F.col("place") < per_band).select("candidate_id", stratum, "band")
    return decisive.unionByName(picked)


def seeded_order(identifiers: list[str], seed: str) -> list[str]:
    """A presentation order on the driver, the same for the same seed."""
    out = sorted(identifiers)
    random.Random(seed).shuffle(out)
    return out


def hashed_order(df: DataFrame, identifier: str, seed: int) -> DataFrame:
    """A distributed pseudo-random order: adds the sort key ``place``."""
    return df.withColumn("place", F.xxhash64(F.lit(seed), F.col(identifier)))


def rotating_arms(df: DataFrame, identifier: str, arms: list[str]) -> DataFrame:
    """Each row's order of arms, rotated by its 0-based position."""
    at = F.pmod("place", F.lit(len(arms))).cast("int")
    every = F.array(*[F.lit(a) for a in arms])
    turned = F.concat(F.slice(every, at + 1, F.lit(len(arms))), F.slice(every, F.lit(1), at))
    return placed(df.select(identifier), [identifier]).select(identifier, turned.alias("arms"))


def preflight(df: DataFrame, size: str, identifier: str) -> DataFrame:
    """The rows of least, lower-median and largest size, by (size, id)."""
    ordered = placed(df.select(identifier, size), [size, identifier])
    picked = (F.col("place") == 0) | (F.col("place") == F.floor((F.col("placed_of") - 1) / 2)) | (F.col("place") == F.col("placed_of") - 1)
    return ordered.filter(picked).select(identifier, size, (F.col("place") + 1).alias("at"))
