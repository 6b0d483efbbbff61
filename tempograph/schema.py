"""Periods, identities and other shared column expressions. Periods are strings `YYYYQn`; their lexical order is chronological."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = re.compile(r"^\d{4}Q[1-4]$")


def check_period(period: str) -> str:
    if not PERIOD.match(period):
        raise ValueError(f"not a period: {period!r}")
    return period


def period_of(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def first_day(period: Column) -> Column:
    return F.make_date(F.substring(period, 1, 4).cast("int"), (F.substring(period, 6, 1).cast("int") - 1) * 3 + 1, F.lit(1))


def last_day(period: Column) -> Column:
    return F.last_day(F.add_months(first_day(period), 2))


def previous_period(period: str) -> str:
    year, quarter = int(period[:4]), int(period[5])
    return f"{year - 1}Q4" if quarter == 1 else f"{year}Q{quarter - 1}"


def consecutive_quarters(start: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: period_of(F.add_months(first_day(start), i * 3)))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)
