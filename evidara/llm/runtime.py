"""Shared plumbing: checkpoints in the cluster's folder, table reading, hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
MASK = (1 << 64) - 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and driver and
    executors are one process (tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return os.path.dirname(made)
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="evidara-"))
    return _OWN_DIR[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def restarted(df: DataFrame) -> tuple[DataFrame, str]:
    """A checkpoint of ``df`` without its size estimate, and its path.

    A checkpoint carries the estimate on, and a loop of joins would square it in every round.
    """
    spark, held = df.sparkSession, checkpointed(df)
    rdd = held._jdf.queryExecution().logical().rdd()
    plain = DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, held._jdf.schema(), False), spark)
    return plain, rdd.getCheckpointFile().get()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a checkpoint that nothing will read again."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (it is counted); as it is beyond that."""
    return F.broadcast(df) if df.count() <= most else df


#: Names of the two columns that tell texts apart.
TEXT_KEYS = ("__k1", "__k2")


def with_text_keys(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with 128 bits of hash of a text column; a null text counts as the empty one."""
    text = F.coalesce(F.col(column), F.lit(""))
    return df.withColumns({TEXT_KEYS[0]: F.xxhash64(text), TEXT_KEYS[1]: F.xxhash64(F.lit(1), text)})


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64 (wraps silently)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def to_signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, which is what Spark's LongType holds."""
    return x.view(np.int64)


def crc_residue(column: str, modulus: int):
    """crc32 of a column written as text, modulo ``modulus`` (null key: of '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def runs(column: pa.Array, most: int = 1_000_000, rows: int = 500):
    """Lists of a column's texts, each of about so many characters, or one longer text."""
    run: list = []
    held = 0
    for at in range(0, len(column), rows):
        for text in column.slice(at, rows).to_pylist():
            run.append(text)
            held += len(text or "")
            if held >= most:
                yield run
                run, held = [], 0
    if run:
        yield run


def slices(column: pa.Array, most: int = 1_000_000, rows: int = 2000):
    """Parts of a column of texts, each of about so many bytes and at most so many rows, or one longer text."""
    if not len(column):
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    ends = np.cumsum(size)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "left")) + 1), len(column))
        yield column.slice(at, to - at)
        at = to


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives free memory back to the system at the end of a task.

    A worker stays idle beside what its executor does next, and would keep all that its tasks took.
    """

    def held(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
        if trim is not None:
            trim(0)

    return held


def shuffle_width(spark: SparkSession) -> int:
    """Over how many partitions a shuffle deals rows: the number of salts that spreads one key over all of them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``left`` joined with the columns of ``right``, which has one row a key, however many rows of ``left`` have one key.

    Rows of ``left`` are dealt by key and by a hash of column ``by``; a row of
    ``right`` is copied only to the hashes that its key has, so there are never
    more copies than rows of ``left``.  Rows without a partner go (inner join).
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(shuffle_width(left.sparkSession))))
    met = salted.select(*keys, "__salt").distinct().groupBy(*keys).agg(F.collect_set("__salt").alias("__salts"))
    dealt = met.join(right, keys).withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(dealt, [*keys, "__salt"]).drop("__salt")
