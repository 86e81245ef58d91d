"""Archives as tables: ranges, rules, round trips and offsets."""

import io
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from evidara.operators.checks import ContractError
from evidara.plans import registry
from evidara.sources import archives, readers

SF = "/root/testdata/sf0.001"


def write_tar(path, entries, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, content, kind in entries:
            info = tarfile.TarInfo(name)
            info.type = kind
            info.size = len(content) if kind == tarfile.REGTYPE else 0
            info.linkname = "/etc/passwd" if kind == tarfile.SYMTYPE else ""
            t.addfile(info, io.BytesIO(content))


def files(*names, content=b"x"):
    return [(n, content, tarfile.REGTYPE) for n in names]


def test_every_range_size_gives_every_member_once(spark, tmp_path):
    want = {f"d/{i}.txt": bytes([65 + i % 26]) * (37 * i % 2000) for i in range(60)}
    write_tar(tmp_path / "a.tar", [("d", b"", tarfile.DIRTYPE), *[(n, c, tarfile.REGTYPE) for n, c in want.items()]])
    for size in (512, 1000, 1 << 20):
        found = archives.members(spark, str(tmp_path / "a.tar"), partitionBytes=size)
        assert size > 1000 or found.rdd.getNumPartitions() > 10
        rows = found.collect()
        assert len(rows) == 60 and {r["name"]: bytes(r["content"]) for r in rows} == want


def test_compressed_archives_and_folders(spark, tmp_path):
    write_tar(tmp_path / "a.tar.gz", files("one", "two"), "w:gz")
    write_tar(tmp_path / "b.tar", files("one"))
    write_tar(tmp_path / ".hidden.tar", files("three"))
    got = archives.members(spark, str(tmp_path)).select("archive", "name").collect()
    assert sorted(map(tuple, got)) == [("a.tar.gz", "one"), ("a.tar.gz", "two"), ("b.tar", "one")]


@pytest.mark.parametrize(
    "entries",
    [files("../out"), files("/etc/x"), files("a\\b"), files("a", "a"), [("a", b"", tarfile.SYMTYPE)], [("a", b"", tarfile.FIFOTYPE)], files("big", content=b"x" * 101), files("a", "b", "c", content=b"x" * 70)],
)
def test_unsafe_archives_are_refused_whole(spark, tmp_path, entries):
    write_tar(tmp_path / "a.tar", [*files("fine"), *entries])
    with pytest.raises(Exception, match="archive refused"):
        archives.members(spark, str(tmp_path / "a.tar"), mostMember=100, mostArchive=200).collect()


def test_pack_and_csv_round_trip(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(['plain', 'two\nlines', 'a "quoted", b', "", None, " spaced ", "back\\slash", "é\r\nü", "plain"])]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    archives.pack(archives.csv_members(df, "t", 2), str(tmp_path / "out"))
    archives.pack(spark.createDataFrame([("none", None)], "name string, content binary"), str(tmp_path / "out"))
    found = archives.members(spark, str(tmp_path / "out"))
    assert found.filter("name = 'none'").first()["size"] == 0
    got = archives.csv_rows(found.filter("name LIKE 't/%'"), ["v", "k"]).collect()
    assert sorted((int(r["k"]), r["v"]) for r in got) == [(k, v or "") for k, v in rows]
    with pytest.raises(Exception, match="has no w"):
        archives.csv_rows(found.filter("name LIKE 't/%'"), ["w"]).collect()
    archives.pack(df.select(F.lit("n").alias("name"), F.lit(None).cast("binary").alias("content")).limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or archives.members(spark, str(tmp_path / "none")).count() == 0


def test_evidence_status(spark):
    cases = [("abcdef", "bcd", "1", "3", "exact"), ("abcdef", "bcx", "1", "3", "mismatch"), ("abcdef", "", "1", "3", "empty_evidence"), ("abcdef", "f", "5", "6", "out_of_bounds"), ("abcdef", "f", "5", "5", "exact"), ("a", "a", "-1", "-1", "publisher_unavailable"), ("a", "a", "x", "0", "invalid_offset"), ("ab", "b", "1", "0", "out_of_bounds"), ("", "", "0", "0", "out_of_bounds")]
    df = spark.createDataFrame(cases, "text string, e string, a string, b string, want string")
    got = df.select("want", archives.evidence_status(F.col("text"), F.col("e"), F.col("a"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_archived_annotations_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()["archived_annotations"](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()['archived_annotations']})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want)) and len(want) > 50


def test_unpack_is_verified(tmp_path):
    write_tar(tmp_path / "a.tar", files("d/one"))
    with pytest.raises(ContractError, match="checksum"):
        readers.unpack(str(tmp_path / "a.tar"), str(tmp_path / "to"), "0" * 32)
    assert readers.unpack(str(tmp_path / "a.tar"), str(tmp_path / "to"), readers.checksum(str(tmp_path / "a.tar"))) == ["d/one"]
    write_tar(tmp_path / "b.tar", files("../two"))
    with pytest.raises(ContractError, match="unsafe"):
        readers.unpack(str(tmp_path / "b.tar"), str(tmp_path / "to"))
