"""Helpers for operators that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for a row however often body's inner functions use it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def constants(values) -> Column:
    """An array of numbers that is part of the plan; its size is a parameter of the model, not of the data. None stays null."""
    return F.split(F.lit(",".join("" if v is None else f"{v:.5g}" for v in values)), ",").try_cast("array<float>")
