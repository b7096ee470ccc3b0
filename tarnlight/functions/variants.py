"""JSON of any shape as variant values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(text: Column) -> Column:
    """The JSON text as a variant; null where it is no JSON. A key that stands twice in an object makes it none."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """The part of a variant at a path such as $.a[0].b as a type; null where there is none or it can't be one of that type."""
    return F.try_variant_get(value, path, kind)


def with_fields(rows: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each name of paths (name: (path, type)) out of the JSON text in a column, and `is_malformed` where that is no JSON and not null. The text is parsed once for all paths."""
    parsed = rows.withColumn("_variant", as_variant(F.col(column)))
    made = [field(F.col("_variant"), path, kind).alias(name) for name, (path, kind) in paths.items()]
    return parsed.select(*rows.columns, *made, (F.col(column).isNotNull() & F.col("_variant").isNull()).alias("is_malformed"))


def inferred_schema(rows: DataFrame, column: str) -> str | None:
    """The one type, in SQL's spelling, that all well-formed values of a column fit; null without any. Merged by partial aggregates."""
    return rows.agg(F.schema_of_variant_agg(as_variant(F.col(column))).alias("kind")).first()["kind"]
