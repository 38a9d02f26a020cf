"""Lenient parsing and label fall-backs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def zero_to_null(number: Column) -> Column:
    return F.nullif(number, F.lit(0).cast("bigint"))


def to_number(text: Column) -> Column:
    """Text to double; whatever is not a number, NaN included, is NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def label_or_id(name: Column, identifier: Column) -> Column:
    return F.coalesce(blank_to_null(name), F.concat(F.lit("ID-"), identifier))
