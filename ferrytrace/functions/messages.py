"""Turning rows into messages and messages back into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_value(columns: Sequence[str], keep_nulls: bool = False) -> Column:
    """All given columns as one JSON object; null fields are left out unless kept."""
    options = {"ignoreNullFields": "false"} if keep_nulls else {}
    return F.to_json(F.struct(*[F.col(c) for c in columns]), options)


def keyed_json(df: DataFrame, key: str, keep_nulls: bool = False) -> DataFrame:
    """``(key, value)`` messages: the key column as text, the whole row as JSON."""
    return df.select(
        F.col(key).cast("string").alias("key"),
        json_value(df.columns, keep_nulls).alias("value"),
    )


def line_value(columns: Sequence[str], sep: str = ",") -> Column:
    """All columns joined into one line; a null becomes an empty field, so fields never shift."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def empty_to_null(column: Column) -> Column:
    """Message key rule: an empty key is no key."""
    return F.nullif(column, F.lit(""))


def value_text(value: Column | str = "value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.cast("string")


def payload_bytes(value: Column | str = "value") -> Column:
    """Byte length of a message value; a missing value weighs nothing."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def parse_json(df: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """JSON message text to the columns of ``schema``."""
    return df.select(F.from_json(value_text(value), schema).alias("data")).select("data.*")


def make_header(name: str, text: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.encode(text, "UTF-8").alias("value"))


def header_text(headers: Column | str, name: str) -> Column:
    """First header called ``name`` as text; null when absent, empty list or null list."""
    headers = F.col(headers) if isinstance(headers, str) else headers
    named = F.filter(headers, lambda h: h["key"] == name)
    return F.decode(F.get(named, F.lit(0))["value"], "UTF-8")


def header_long(headers: Column | str, name: str) -> Column:
    """Integer header; text that is no integer counts as missing."""
    return header_text(headers, name).try_cast("long")
