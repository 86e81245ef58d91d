"""Assertions as queries: counts of offending rows, raised where a caller wants it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A relation breaks the contract of an operator."""


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of this machine only where one process is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ContractError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {spark.sparkContext.master})")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="evidara-"))
    return _OWN_FOLDER[0]


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, after checking that its keys are unique and not null."""
    if not duplicates(df, *keys).isEmpty():
        raise ContractError(f"duplicate keys in {keys}")
    if not df.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).isEmpty():
        raise ContractError(f"null keys in {keys}")
    return df


def require_none(df: DataFrame, what: str) -> None:
    """Raise if ``df``, a relation of violations, has rows."""
    if not df.isEmpty():
        raise ContractError(what)


def difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only, with the side: a full outer reconciliation."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("r", F.lit(True))
    joined = a.join(b, list(keys), "full_outer").filter("l IS NULL OR r IS NULL")
    return joined.select(*keys, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def violations(**conditions: Column) -> Column:
    """Names of the conditions that are true for a row, as a sorted array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name.replace("_", "-"))) for name, c in sorted(conditions.items())]))


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A broadcast hint where the row count is checked and small; else the plain relation, which is then shuffled."""
    return F.broadcast(df) if small(df, most) else df
