"""Small tests and parsers on scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.schemas import MEMORY_STATUSES, MEMORY_TYPES

_RFC3339 = (
    r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
)


def effective_type(c: Column) -> Column:
    """Memory type used for processing: unknown values count as semantic."""
    return F.when(c.isin(*MEMORY_TYPES), c).otherwise(F.lit("semantic"))


def effective_status(c: Column) -> Column:
    """Status used for processing: unknown values count as active."""
    return F.when(c.isin(*MEMORY_STATUSES), c).otherwise(F.lit("active"))


def is_rfc3339(c: Column) -> Column:
    """Null for null, so that absent instants are not reported."""
    fits = c.rlike(_RFC3339) & F.upper(c).try_cast("timestamp").isNotNull()
    return F.when(c.isNotNull(), fits)


def rfc3339(c: Column, as_of: Column | None = None) -> Column:
    """Instant of an RFC 3339 text; ``as_of`` (or null) when it is not one."""
    parsed = F.when(c.rlike(_RFC3339), F.upper(c).try_cast("timestamp"))
    return parsed if as_of is None else F.coalesce(parsed, as_of)


def rfc3339_text(ts: Column) -> Column:
    """Canonical text of an instant, six fraction digits, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_semver(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\z")


def is_checksum(c: Column) -> Column:
    """``algorithm:hex`` split at the first colon."""
    return c.rlike(r"\A[^:]+:[0-9a-fA-F]+\z")
