"""Archives as tables: members of tar files are rows, and rows become members.

Registered as the data source "members".  Reading splits every plain archive
into byte ranges as large as ``partitionBytes``: a task walks the headers, which
only seeks, checks the rules over all of them and reads the members that begin in
its range.  A compressed archive is one range.  Nothing is ever unpacked to disk.

Writing makes one archive a task under a hidden name; the commit shows those of
the tasks that count, so attempts that were lost or repeated leave no rows.
Empty members, empty archives and an empty folder are fine; a null content is empty.
"""

from __future__ import annotations

import csv
import io
import re
import tarfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from evidara.operators.checks import ContractError

#: Bytes of one member and of all members of an archive at most; beyond them the archive is refused.
MOST_MEMBER, MOST_ARCHIVE = 100_000_000, 1_000_000_000
PARTITION_BYTES = 64 << 20
CSV_ROWS = 1000


def _place(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if re.match(r"(?!file:)[a-zA-Z][\w+.-]*:/", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def member_problem(name: str, size: int, regular: bool, most: int = MOST_MEMBER) -> str | None:
    """Why a member may not be read, or None."""
    if name.startswith("/") or "\\" in name or ".." in name.split("/"):
        return "leaves its folder"
    if not regular:
        return "is neither file nor folder"
    return "is too large" if size > most else None


def checked_members(tar: tarfile.TarFile, most: int = MOST_MEMBER, most_archive: int = MOST_ARCHIVE) -> list[tarfile.TarInfo]:
    """All members of an archive; refused whole if one breaks a rule, stands twice, or all are too large together."""
    seen: set[str] = set()
    total = 0
    for m in tar:
        problem = member_problem(m.name, m.size, m.isfile() or m.isdir(), most) or ("stands twice" if m.name in seen else None)
        total += m.size
        if problem or total > most_archive:
            raise ContractError(f"archive refused: {m.name} {problem or 'makes it too large'}")
        seen.add(m.name)
    return tar.getmembers()


@dataclass
class ArchiveRange(InputPartition):
    archive: str
    start: int
    end: int | None

    def __init__(self, archive: str, start: int, end: int | None):
        self.archive, self.start, self.end = archive, start, end


class MembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("mostMember", MOST_MEMBER))
        self.most_archive = int(options.get("mostArchive", MOST_ARCHIVE))
        self.range = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[ArchiveRange]:
        from pyarrow import fs

        files, path = _place(self.path)
        at = files.get_file_info(path)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [at] if at.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name[0] in "._":
                continue
            cuts = range(0, max(1, f.size), self.range) if f.extension == "tar" else [0]
            out += [ArchiveRange(f.path, a, a + self.range if f.extension == "tar" else None) for a in cuts]
        return out or [ArchiveRange("", 0, None)]

    def read(self, partition: ArchiveRange):
        if not partition.archive:
            return
        files, _ = _place(self.path)
        with files.open_input_file(partition.archive) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:
            for m in checked_members(tar, self.most, self.most_archive):
                if m.isfile() and m.offset >= partition.start and (partition.end is None or m.offset < partition.end):
                    yield partition.archive.rsplit("/", 1)[-1], m.name, m.size, tar.extractfile(m).read()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class MembersWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        files, path = _place(self.path)
        files.create_dir(path, recursive=True)
        name, stream, tar = f"part-{uuid.uuid4().hex}.tar", None, None
        try:
            for row in iterator:
                if tar is None:
                    stream = files.open_output_stream(f"{path}/.{name}")
                    tar = tarfile.open(fileobj=stream, mode="w|")
                content = bytes(row["content"] or b"")
                if problem := member_problem(row["name"], len(content), True):
                    raise ContractError(f"{row['name']} {problem}")
                info = tarfile.TarInfo(row["name"])
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
            if tar is not None:
                tar.close()
        finally:
            if stream is not None:
                stream.close()
        return Written(name if tar is not None else None)

    def commit(self, messages) -> None:
        files, path = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{path}/.{m.name}", f"{path}/{m.name}")

    def abort(self, messages) -> None:
        files, path = _place(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{path}/.{m.name}")


class Members(DataSource):
    """Rows (archive, name, size, content) of the files in tar archives."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return "archive string, name string, size long, content binary"

    def reader(self, schema) -> MembersReader:
        return MembersReader(self.options)

    def writer(self, schema, overwrite: bool) -> MembersWriter:
        return MembersWriter(self.options)


def members(spark: SparkSession, path: str, **options) -> DataFrame:
    """Members of an archive, or of all archives in a folder."""
    spark.dataSource.register(Members)
    return spark.read.format("members").options(**options).load(path)


def pack(rows: DataFrame, path: str) -> None:
    """Append rows (name, content) to a folder of archives, one archive a task."""
    spark = rows.sparkSession
    spark.dataSource.register(Members)
    own = rows.select(F.lit(None).cast("string").alias("archive"), "name", F.length("content").cast("long").alias("size"), "content")
    own.write.format("members").mode("append").save(path)


def csv_members(rows: DataFrame, folder: str, rows_each: int = CSV_ROWS) -> DataFrame:
    """Rows as quoted CSV members (name, content) under one header each, about ``rows_each`` of them to a member, dealt by hash and a draw."""
    shards = max(1, rows.count() // rows_each)
    shown = {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    line = F.to_csv(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]), shown)
    dealt = rows.select(line.alias("line"), F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(shards)).alias("shard"))
    head = ",".join(f'"{c}"' for c in rows.columns)
    body = F.concat(F.lit(head + "\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n"))
    return dealt.groupBy("shard").agg(body.cast("binary").alias("content")).select(F.concat(F.lit(f"{folder}/part-"), F.col("shard").cast("string"), F.lit(".csv")).alias("name"), "content")


def csv_rows(found: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of CSV members by their header, as strings; a member without one of the fields is refused, as is a row cut short."""

    def read(batches):
        csv.field_size_limit((1 << 31) - 1)
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                lines = csv.DictReader(io.StringIO(content.as_py().decode("utf-8"), newline=""))
                if missing := [f for f in fields if f not in (lines.fieldnames or [])]:
                    raise ContractError(f"{name} has no {', '.join(missing)}")
                held: list[list[str]] = []
                for line in lines:
                    row = [line[f] for f in fields]
                    if None in row:
                        raise ContractError(f"{name} has a row that is cut short")
                    held.append(row)
                    if len(held) == CSV_ROWS:
                        yield _batch(held, fields)
                        held = []
                if held:
                    yield _batch(held, fields)

    return found.select("name", "content").mapInArrow(read, ", ".join(f"`{f}` string" for f in fields))


def _batch(rows: list[list[str]], fields: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], fields)


def evidence_status(text, evidence, start, end):
    """What an annotation's inclusive offsets say about its evidence in a text: exact, mismatch, or why that cannot be told."""
    a, b = start.try_cast("int"), end.try_cast("int")
    return (
        F.when(a.isNull() | b.isNull(), "invalid_offset")
        .when((a == -1) & (b == -1), "publisher_unavailable")
        .when((a < 0) | (b < a) | (b >= F.length(text)), "out_of_bounds")
        .when(F.coalesce(evidence, F.lit("")) == "", "empty_evidence")
        .when(text.substr(a + 1, b - a + 1) == evidence, "exact")
        .otherwise("mismatch")
    )
