"""Date functions at the edges: strict parsing and epoch seconds."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def strict_date(text: str | dt.date | None) -> dt.date | None:
    """YYYY-MM-DD only; Spark's own cast would accept 2022-1 as a date."""
    if text is None or isinstance(text, dt.date):
        return text
    if not _ISO.fullmatch(text):
        raise ValueError("invalid date")
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise ValueError("invalid date") from None


def epoch_to_date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def date_to_epoch(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 86400


def file_date(path: Column) -> Column:
    """Date in a path such as .../2022/01/15/roas.csv.xz."""
    return F.to_date(F.regexp_extract(path, r"/(\d{4}/\d{2}/\d{2})/[^/]*$", 1), "yyyy/MM/dd")


def in_bounds(day: Column, since: dt.date | None, until: dt.date | None) -> Column:
    """Whole-date bounds, both inclusive and optional (months are never compared without their year)."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (day >= F.lit(since))
    if until is not None:
        cond = cond & (day <= F.lit(until))
    return cond
