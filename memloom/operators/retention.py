"""How long memory is kept: tiers by importance, and the upkeep of note files by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.notes import daily_date

#: Least importance of a tier, its name, and the days it is kept (None: for ever).
TIERS = ((0.8, "structural", None), (0.4, "potential", 30), (0.0, "contextual", 7))
#: Days after which a daily or session note is archived, and after which an archived one goes.
ARCHIVE_DAYS, PURGE_DAYS = 7, 30


def tier(importance: Column) -> Column:
    """Tier of an importance score; null for memory without one, which stays."""
    out = F.when(importance.isNull() | F.isnan(importance), F.lit(None).cast("string"))
    for least, name, _ in TIERS[:-1]:
        out = out.when(importance >= least, name)
    return out.otherwise(TIERS[-1][1])


def expires_at(importance: Column, seen: Column) -> Column:
    """When memory seen at ``seen`` goes; null where it stays."""
    days = F.lit(None).cast("int")
    for _, name, kept in TIERS:
        days = F.when(tier(importance) == name, F.lit(kept).cast("int")).otherwise(days)
    return F.when(days.isNotNull(), seen + F.make_dt_interval(days))


def last_seen(observations: DataFrame) -> DataFrame:
    """One row for each (``agent_id``, ``id``): its last observation, by ``seen`` and then ``importance``.

    Only the two columns that count are gathered, with partial maxima, so an id that holds
    most observations costs no more than others.
    """
    last = F.max(F.struct("seen", "importance")).alias("last")
    return observations.where("seen IS NOT NULL").groupBy("agent_id", "id").agg(last).select("agent_id", "id", "last.*")


def retention(observations: DataFrame, as_of: Column) -> DataFrame:
    """``agent_id``, ``id``, ``tier``, ``expires_at`` and whether it ``expired`` by ``as_of``, by the last observation.

    Observing memory again starts its time anew, with the importance it has then.
    """
    end = expires_at(F.col("importance"), F.col("seen"))
    rows = last_seen(observations).select("agent_id", "id", tier(F.col("importance")).alias("tier"), end.alias("expires_at"))
    return rows.withColumn("expired", F.coalesce(F.col("expires_at") <= as_of, F.lit(False)))


def retained(observations: DataFrame, as_of: Column) -> DataFrame:
    """The observations of all memory that has not expired by ``as_of``."""
    gone = retention(observations, as_of).where("expired").select("agent_id", "id")
    return observations.join(gone, ["agent_id", "id"], "left_anti")


def upkeep(files: DataFrame, as_of: Column, archive: int = ARCHIVE_DAYS, purge: int = PURGE_DAYS) -> DataFrame:
    """``agent_id``, ``path``, ``action`` (keep, archive, purge) and ``target`` of note files.

    Daily notes count from their day, session notes from ``mtime``; below ``memory/archive/``
    by the same, and those go.  Every other file stays.  A row each, no shuffle.
    """
    p = F.lower("path")
    inside = p.startswith("memory/archive/")
    plain = F.when(inside, F.concat(F.lit("memory/"), F.substr("path", F.lit(len("memory/archive/") + 1)))).otherwise(F.col("path"))
    session = F.lower(plain).rlike(r"\Amemory/session_[^/]*\.md\z")
    start = F.coalesce(daily_date(plain), F.when(session, F.col("mtime").cast("date")))
    age = F.date_diff(as_of.cast("date"), start)
    action = F.when(inside & (age >= purge), "purge").when(~inside & (age >= archive), "archive").otherwise("keep")
    name = F.substr("path", F.lit(len("memory/") + 1))
    target = F.when(action == "archive", F.concat(F.lit("memory/archive/"), name)).when(action == "keep", F.col("path"))
    return files.select("agent_id", "path", action.alias("action"), target.alias("target"))
