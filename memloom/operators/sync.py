"""Planning of sync and restore over a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sync_plan(agents: DataFrame, state: DataFrame, counts: DataFrame) -> DataFrame:
    """What each agent has to push: a snapshot, a delta, or nothing.

    An agent counts as synced once ``last_synced_at`` is set, even at sequence 0.
    """
    n = F.coalesce(F.col("creates") + F.col("updates") + F.col("deletes"), F.lit(0))
    action = (
        F.when(F.col("last_synced_at").isNull(), "snapshot")
        .when(n > 0, "delta")
        .otherwise("no_changes")
    )
    joined = agents.select("agent_id").distinct().join(state, "agent_id", "left").join(
        counts, "agent_id", "left"
    )
    changed = F.when(action == "delta", n).otherwise(0)
    return joined.select(
        "agent_id",
        action.alias("action"),
        F.coalesce("last_synced_sequence", F.lit(0)).cast("bigint").alias("base_sequence"),
        changed.cast("bigint").alias("changes"),
    )


def advance_state(state: DataFrame, results: DataFrame) -> DataFrame:
    """Sync state after pushes or restores.

    ``results``: ``agent_id, sequence, at, snapshot_path``; agents without a result
    keep their state, new ones are added.
    """
    r = results.select(
        "agent_id", F.col("sequence").alias("_seq"), F.col("at").alias("_at"),
        F.col("snapshot_path").alias("_path"), F.lit(True).alias("_new"),
    )
    pick = lambda new, old: F.when(F.col("_new"), F.col(new)).otherwise(F.col(old))
    return state.join(r, "agent_id", "full_outer").select(
        "agent_id",
        pick("_seq", "last_synced_sequence").cast("bigint").alias("last_synced_sequence"),
        pick("_at", "last_synced_at").alias("last_synced_at"),
        pick("_path", "snapshot_path").alias("snapshot_path"),
    )


def deltas_since(deltas: DataFrame, since: Column | DataFrame) -> DataFrame:
    """Deltas above a sequence (X19), one for all agents or ``agent_id, since`` rows.

    Sort by ``(agent_id, sequence)`` to replay.
    """
    if isinstance(since, Column):
        return deltas.where(F.col("sequence") > since)
    return deltas.join(since.select("agent_id", "since"), "agent_id").where(
        F.col("sequence") > F.col("since")
    ).drop("since")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot with the highest sequence per agent."""
    best = snapshots.groupBy("agent_id").agg(
        F.max_by(F.struct(*[c for c in snapshots.columns if c != "agent_id"]), "sequence").alias("s")
    )
    return best.select("agent_id", "s.*")


def restore_plan(agents: DataFrame, snapshots: DataFrame, deltas: DataFrame) -> DataFrame:
    """Archives to read per agent, in order: its latest snapshot, then later deltas.

    ``step`` 0 is the snapshot and deltas follow by sequence; an agent without a
    snapshot gets one row of kind ``error``.
    """
    latest = latest_snapshots(snapshots).select(
        "agent_id", F.col("sequence").alias("_snap"), F.col("url").alias("_url")
    )
    asked = agents.select("agent_id").distinct().join(latest, "agent_id", "left")
    heads = asked.select(
        "agent_id",
        F.when(F.col("_snap").isNull(), "error").otherwise("snapshot").alias("kind"),
        F.col("_snap").cast("bigint").alias("sequence"),
        F.col("_url").alias("url"),
    )
    later = deltas.join(
        asked.where(F.col("_snap").isNotNull()).select("agent_id", "_snap"), "agent_id"
    ).where(F.col("sequence") > F.col("_snap")).select(
        "agent_id", F.lit("delta").alias("kind"), F.col("sequence").cast("bigint").alias("sequence"),
        "url",
    )
    return heads.unionByName(later)


def restored_state(plan: DataFrame, at: Column) -> DataFrame:
    """State rows after a restore: the last delta's sequence, else the snapshot's."""
    ok = plan.where(F.col("kind") != "error")
    return ok.groupBy("agent_id").agg(F.max("sequence").alias("sequence")).select(
        "agent_id", "sequence", at.alias("at"), F.lit(None).cast("string").alias("snapshot_path")
    )


def sequence_conflicts(pushed: DataFrame, latest: DataFrame) -> DataFrame:
    """Pushed deltas whose base is not the latest known sequence of the agent.

    ``pushed``: ``agent_id, base_sequence``; ``latest``: ``agent_id, sequence`` (absent
    agents count as 0).
    """
    known = latest.groupBy("agent_id").agg(F.max("sequence").alias("latest_sequence"))
    joined = pushed.join(known, "agent_id", "left").withColumn(
        "latest_sequence", F.coalesce("latest_sequence", F.lit(0)).cast("bigint")
    )
    return joined.where(F.col("base_sequence") != F.col("latest_sequence"))


def fleet_status(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Last sequence, last time and whether a snapshot exists, per agent."""
    have = snapshots.select("agent_id").distinct().withColumn("_has", F.lit(True))
    return state.join(have, "agent_id", "left").select(
        "agent_id",
        F.coalesce("last_synced_sequence", F.lit(0)).cast("bigint").alias("last_synced_sequence"),
        "last_synced_at",
        F.coalesce("_has", F.lit(False)).alias("snapshot_exists"),
    )
