"""Rounding, grades and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Halves go up, also below zero (unlike SQL's round)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + F.lit(0.5)) / 10


def status(value: Column, passes: float, partly: float) -> Column:
    return F.when(value >= passes, "pass").when(value >= partly, "partial").otherwise("fail")


def partly_if_any(value: Column, passes: float) -> Column:
    return F.when(value >= passes, "pass").when(value > 0, "partial").otherwise("fail")


def few(count: Column, most: int) -> Column:
    """Pass without any, partial with a few, else fail."""
    return F.when(count == 0, "pass").when(count <= most, "partial").otherwise("fail")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").when(
        score >= 50, "D",
    ).otherwise("F")


def confidence_level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 45, "medium").otherwise("low")
