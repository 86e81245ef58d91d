"""Scans: corpora, queries, judgements, records, archives and XML."""

from __future__ import annotations

import hashlib
import os
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidara import schemas
from evidara.functions.strict_json import json_problem
from evidara.operators.checks import ContractError, kept, require_unique


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of _id, title and text; a missing title is empty."""
    return spark.read.schema(schemas.CORPUS).json(path).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of _id and text; of doubled ids the last line wins (by file and position)."""
    rows = spark.read.schema(schemas.QUERY).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("place", F.monotonically_increasing_id())
    last = W.partitionBy("_id").orderBy(F.desc("file"), F.desc("place"))
    return rows.withColumn("at", F.row_number().over(last)).filter("at = 1").select(F.col("_id").alias("query_id"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated query_id, doc_id and grade under a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schemas.QRELS, mode="FAILFAST", enforceSchema=True)
    return rows.select("query_id", "doc_id", F.col("score").alias("grade"))


def unique_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with an id that must be there and be unique."""
    return require_unique(spark.read.schema(schema).json(path, mode="FAILFAST"), key)


def strict_records(spark: SparkSession, path: str, schema: str, run_id: str | None = None) -> DataFrame:
    """JSON lines without blank or malformed lines, repeated keys, unknown fields or (if given) records of another run.

    The lines are read once and kept; what is wrong with any of them is counted in one pass.
    """
    fields = F.array(*[F.lit(f.split()[0]) for f in _top_fields(schema)])
    read = spark.read.text(path, wholetext=False)
    problem = F.coalesce(json_problem(F.col("value")), F.when(F.size(F.array_except(F.json_object_keys("value"), fields)) > 0, "unknown-field"))
    record = F.when(problem.isNull(), F.from_json("value", schema, {"mode": "FAILFAST"}))
    lines = kept(read.select(problem.alias("problem"), record.alias("r")))
    if run_id is not None:
        lines = lines.withColumn("problem", F.coalesce("problem", F.when(~F.col("r.run_id").eqNullSafe(F.lit(run_id)), "another-run")))
    found = {r["problem"]: r["n"] for r in lines.filter("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
    if found:
        raise ContractError(f"refused lines: {', '.join(f'{n} {k}' for k, n in sorted(found.items()))}")
    return lines.select("r.*")


def _top_fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated files under a header, quoted fields over several lines included."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def xml_metadata(articles: DataFrame, column: str = "xml") -> DataFrame:
    """Title, article ids, licence links and contributors of article XML in a string column."""
    return articles.withColumns(
        {
            "title": F.xpath_string(column, F.lit("//article-title")),
            "article_ids": F.xpath(column, F.lit("//article-id/text()")),
            "licences": F.xpath(column, F.lit("//license/@*")),
            "contributors": F.xpath(column, F.lit("//contrib//surname/text()")),
        }
    )


def checksum(path: str, kind: str = "md5") -> str:
    digest = hashlib.new(kind)
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def unpack(archive: str, destination: str, expected: str | None = None, kind: str = "md5", most_bytes: int = 1 << 32) -> list[str]:
    """Unpack a verified zip or tar on the driver; members that leave the folder, links and oversize archives are refused."""
    if expected and checksum(archive, kind) != expected:
        raise ContractError("checksum mismatch")
    root = os.path.realpath(destination)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            _safe([(m.filename, m.file_size, False) for m in z.infolist()], root, most_bytes)
            z.extractall(root)
            return z.namelist()
    with tarfile.open(archive) as t:
        members = t.getmembers()
        _safe([(m.name, m.size, not (m.isfile() or m.isdir())) for m in members], root, most_bytes)
        t.extractall(root, filter="data")
        return [m.name for m in members]


def _safe(members: list[tuple[str, int, bool]], root: str, most: int) -> None:
    seen = set()
    for name, _, odd in members:
        target = os.path.realpath(os.path.join(root, name))
        if odd or os.path.isabs(name) or os.path.commonpath([root, target]) != root or name in seen:
            raise ContractError(f"unsafe member {name}")
        seen.add(name)
    if sum(size for _, size, _ in members) > most:
        raise ContractError("archive is too large")
