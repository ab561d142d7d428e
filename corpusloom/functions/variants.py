"""Values of open form, as Spark's VARIANT: the types that a column holds, and fields of nested metadata by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("chosen", "rejected")


def json_variant(text: Column) -> Column:
    """The variant of a JSON text; null where the text is no JSON."""
    return F.try_parse_json(text)


def value_type(value: Column, kind: T.DataType) -> Column:
    """What a value is: null, text, malformed or the schema of its JSON (fractions as double); of other columns the type."""
    if not isinstance(kind, T.StringType):
        return F.when(value.isNull(), "null").otherwise(kind.simpleString())
    v = json_variant(value)
    looks = F.trim(value).rlike(r'^[\[{]')
    return F.when(value.isNull(), "null").when(~looks, "text").when(v.isNull(), "malformed").otherwise(F.regexp_replace(F.lower(F.schema_of_variant(v)), r"decimal\([0-9]+,[0-9]+\)", "double"))


def type_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, n): how many values of each type every column holds; one pass, summed before the exchange."""
    chosen = [f for f in df.schema if columns is None or f.name in columns]
    told = F.array(*[F.struct(F.lit(f.name).alias("column"), value_type(F.col(f"`{f.name}`"), f.dataType).alias("type")) for f in chosen])
    return df.select(F.explode(told).alias("t")).groupBy("t.column", "t.type").agg(F.count(F.lit(1)).alias("n"))


def preference_sides(metadata: Column) -> Column:
    """struct(chosen_score, chosen_rank, rejected_score, rejected_rank) of the metadata of a preference pair.

    A side that is missing, or no object, or a value that is no number has null; metadata that is no JSON has four.
    """
    v = json_variant(metadata)
    number = lambda side, name, kind: F.try_variant_get(v, f"$.{side}.{name}", kind)
    return F.struct(*[number(s, n, k).alias(f"{s}_{n}") for s in SIDES for n, k in (("score", "double"), ("rank", "bigint"))])
