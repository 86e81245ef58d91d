"""Strict JSON records and nested keys."""

import pytest
from pyspark.sql import functions as F

from evidara.functions.strict_json import json_problem, json_value, nested_keys
from evidara.operators import reports
from evidara.operators.checks import ContractError
from evidara.sources import readers

TEXTS = {
    1: r'{"a": [{"user_id": 1}, 3, [{"b": {}}]], "c": "\"user_id\": 1"}', 2: '{"a": 1, "a": 2}', 3: "{bad", 4: "[]", 5: None, 6: "3", 7: '{"a": {"b": 1, "b": 2}}',
    8: '{"x": 1} trailing', 9: " ", 10: '{"x": 1}, {"y": 2}', 11: "null", 12: '{"user_id": null}', 13: r'{"k": 1, "k": 2}', 14: "[" * 20 + '{"deep": 1}' + "]" * 20, 15: "]", 16: "1], [2", 17: '1, "w": 2', 18: '1}, {"v": 2',
}


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, j string")


def test_problems(spark):
    got = {r.id: r.p for r in frame(spark).select("id", json_problem(F.col("j")).alias("p")).collect()}
    expected = dict.fromkeys(TEXTS) | {2: "duplicate-key", 3: "malformed", 5: "blank", 7: "duplicate-key", 8: "malformed", 9: "blank", 10: None, 13: "duplicate-key", 15: "malformed", 16: "malformed", 17: "several-values", 18: "several-values"}
    assert got.pop(10) is not None and expected.pop(10) is None
    assert got == expected
    assert {r.id for r in frame(spark).filter(json_value(F.col("j")).isNotNull()).collect()} == {k for k, v in got.items() if v is None}
    assert frame(spark).filter("id = 11").select(json_value(F.col("j")).cast("string").alias("v")).first().v is None  # JSON's null is a value


def test_keys_at_every_depth(spark):
    keys = {(r.id, r.level, r.key) for r in nested_keys(frame(spark), "j", "id").collect()}
    assert keys == {(1, 0, "a"), (1, 0, "c"), (1, 2, "user_id"), (1, 3, "b"), (12, 0, "user_id"), (14, 20, "deep")}
    found = {r.id: (r.forbidden, r.problem) for r in reports.forbidden_keys(frame(spark), "id", "j", ["user_id", "b"]).collect()}
    assert found[1] == (["b", "user_id"], None) and found[12] == (["user_id"], None) and found[7] == (None, "duplicate-key")
    assert not {4, 6, 11, 14} & set(found)


def test_strict_records_refuse_and_say_why(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"run_id": "r", "v": 1}\n{"v": null, "run_id": "r"}\n')
    schema = "run_id string, v int"
    assert readers.strict_records(spark, str(path), schema, "r").count() == 2
    for line, why in (("", "blank"), ('{"run_id": "r", "v": 1, "v": 2}', "duplicate-key"), ('{"run_id": "r", "w": 1}', "unknown-field"), ('{"run_id": "q", "v": 1}', "another-run"), ("{", "malformed")):
        path.write_text('{"run_id": "r", "v": 1}\n' + line + "\n" + '{"run_id": "r", "v": 3}\n')
        with pytest.raises(ContractError, match=why):
            readers.strict_records(spark, str(path), schema, "r")
