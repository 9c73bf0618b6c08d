"""Quarter partitions: path, label and date range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_label(ts: Column) -> Column:
    """``YYYY-QN`` of an instant."""
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def partition_path(observed_at: Column, created_at: Column) -> Column:
    """Partition file of a record: when it was observed, else when it was created."""
    return F.concat(
        F.lit("memory/"), quarter_label(F.coalesce(observed_at, created_at)), F.lit(".jsonl")
    )


def quarter_start(ts: Column) -> Column:
    """First day of the quarter of an instant; cheaper to group by than a path."""
    return F.trunc(ts, "quarter")


def quarter_info(start: Column) -> list[Column]:
    """``file, from, to`` of a quarter given by its first day."""
    return [
        F.concat(F.lit("memory/"), quarter_label(start), F.lit(".jsonl")).alias("file"),
        start.alias("from"),
        F.last_day(F.add_months(start, 2)).alias("to"),
    ]


def partition_range(path: Column) -> Column:
    """``struct<from:date,to:date>`` of a partition path; null for any other path."""
    part = r"\A(?:memory/)*(\d{1,4})-Q0*([1-4])(?:\.jsonl)*\z"
    year = F.lpad(F.regexp_extract(path, part, 1), 4, "0")
    month = (F.regexp_extract(path, part, 2).try_cast("int") - 1) * 3 + 1
    start = F.concat_ws("-", year, month.cast("string"), F.lit("01")).try_cast("date")
    return F.when(
        path.rlike(part) & start.isNotNull(),
        F.struct(start.alias("from"), F.last_day(F.add_months(start, 2)).alias("to")),
    )
