"""JSON columns: paths, elements and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_path(c: Column, path: str) -> Column:
    """The value at a path such as ``$.a.b`` as text; null where it is missing."""
    return F.get_json_object(c, path)


def json_elements(c: Column, element: str = "string") -> Column:
    """A JSON array as an array of ``element``; null where the text is no array."""
    return F.from_json(c, f"array<{element}>")


def json_length(c: Column) -> Column:
    """Elements of a JSON array; 0 for any other valid value."""
    return F.when(json_type(c) == "array", F.json_array_length(c)).when(json_valid(c), 0)


def json_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def json_type(c: Column) -> Column:
    """object, array, text, integer, real, true, false or null."""
    s = F.substring(F.ltrim(c), 1, 1)
    value = F.btrim(c)
    return (
        F.when(~json_valid(c), None)
        .when(s == "{", "object")
        .when(s == "[", "array")
        .when(s == '"', "text")
        .when(value.isin("true", "false", "null"), value)
        .when(value.rlike("^-?[0-9]+$"), "integer")
        .otherwise("real")
    )


def json_group(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """One JSON array a group, its elements in ascending order."""
    return df.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(column))).alias(name))


def json_each(df: DataFrame, column: str, name: str = "value", element: str = "string") -> DataFrame:
    """One row for each element of a JSON array, with its place as ``key``."""
    return df.select("*", F.posexplode(json_elements(F.col(column), element)).alias("key", name))
