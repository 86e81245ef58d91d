"""Strict JSON: one value a text, no repeated key in any object, and every nested key by name, however it is escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.checks import ContractError, kept

#: Objects and arrays nested deeper than this are refused, which bounds the rounds of ``nested_keys``.
MOST_LEVELS = 100


def _framed(text: Column) -> Column:
    """The text as a member of an object in front of a member named by the text's digest, which no text can hold itself.

    So the object ends where the text ends only if the text is one whole value.
    """
    return F.concat(F.lit('{"v": '), text, F.lit(', "'), F.sha2(text.cast("binary"), 256), F.lit('": 0}'))


def json_problem(text: Column) -> Column:
    """Why a text is not one strict JSON value: blank, malformed, duplicate-key or several-values; null if it is."""
    framed = _framed(text)
    keys = F.json_object_keys(framed)
    whole = (F.size(keys) == 2) & F.array_contains(keys, F.sha2(text.cast("binary"), 256))
    # Without a repeated key, what reads as JSON is also a variant.
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "blank")
        .when(F.try_parse_json(framed).isNotNull(), F.when(~F.coalesce(whole, F.lit(False)), "several-values"))
        .when(F.get_json_object(framed, "$").isNotNull(), "duplicate-key")
        .otherwise("malformed")
    )


def json_value(text: Column) -> Column:
    """The value of a strict JSON text as a variant; null where ``json_problem`` is not."""
    return F.when(json_problem(text).isNull(), F.variant_get(F.try_parse_json(_framed(text)), "$.v", "variant"))


def nested_keys(df: DataFrame, column: str, *identifiers: str) -> DataFrame:
    """(identifiers, level, key, value): every key of every object at any depth of the strict JSON in ``column``.

    Values are taken apart a level at a time, one pass over what the level
    before left; a quoted key inside a string is no key.
    """
    spark = df.sparkSession
    left = df.select(*identifiers, json_value(F.col(column)).alias("__value")).filter("__value IS NOT NULL")
    out = None
    for level in range(MOST_LEVELS + 1):
        if level == MOST_LEVELS:
            raise ContractError(f"JSON is nested deeper than {MOST_LEVELS} levels")
        found = kept(left.lateralJoin(spark.tvf.variant_explode(F.col("__value").outer())).select(*identifiers, F.lit(level).alias("level"), "key", "value"))
        own = found.filter("key IS NOT NULL")
        out = own if out is None else out.unionByName(own)
        kind = F.schema_of_variant("value")
        left = found.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY") | kind.startswith("VARIANT")).select(*identifiers, F.col("value").alias("__value"))
        if left.isEmpty():
            return out
    return out
