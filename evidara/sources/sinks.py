"""Sinks: journals, partitioned chunks, atomic reports, write-once artefacts."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.operators.checks import ContractError


def append_journal(records: DataFrame, path: str) -> None:
    """Append records as canonical JSON lines (columns in the order of their names)."""
    records.select(F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks partitioned by representation; only the partitions present are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("representation").parquet(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, Unicode as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_report(report: DataFrame | dict, path: str) -> None:
    """Write a small report atomically on the driver: temporary file, fsync, rename."""
    content = report if isinstance(report, dict) else [r.asDict(recursive=True) for r in report.collect()]
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(content, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, 0o644)
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def write_once(content: str, path: str) -> bool:
    """Create a file; the same content again is no change (False), other content an error."""
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        return True
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            if f.read() != content:
                raise ContractError(f"{path} exists with other content") from None
        return False
