"""Keeping a log in shape: what compaction and vacuum leave, what they report, and when they run."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import latest

# The lease in milliseconds, its growth per byte and per file, and its cap.
LEASE_BASE, LEASE_PER_BYTE, LEASE_PER_FILE, LEASE_CAP = 30_000, 0.00003, 200, 600_000


def compacted(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Base and pending versions as one log: every version is kept, so state and history don't change."""
    return base.unionByName(delta, allowMissingColumns=True)


def compaction_stats(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row ``(mutations_processed, versions)``."""
    n = delta.agg(F.count(F.lit(1)).alias("mutations_processed"))
    m = base.agg(F.count(F.lit(1)).alias("b"))
    return n.crossJoin(m).select("mutations_processed", (F.col("b") + F.col("mutations_processed")).alias("versions"))  # one row each


def vacuumed(log: DataFrame) -> DataFrame:
    """The latest version of each id that isn't deleted. Expired documents stay until they are deleted."""
    return latest(log).where(~F.col("deleted"))


def vacuum_stats(log: DataFrame) -> DataFrame:
    """One row ``(scanned, kept, removed)``; the last version per id is one maximum, combined before the shuffle."""
    per_id = log.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("deleted", F.struct("ord", "ts", "deleted")).alias("gone"))
    out = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.count_if(~F.col("gone")).alias("kept"))
    return out.withColumn("removed", F.col("scanned") - F.col("kept"))


def lease_ms(base_bytes: int, pending_files: int, vacuum: bool = False, base: int = LEASE_BASE) -> int:
    """How long a maintenance lease lasts, by the work ahead; a vacuum takes twice as long."""
    t = min(base + base_bytes * LEASE_PER_BYTE + pending_files * LEASE_PER_FILE, LEASE_CAP)
    return int(min(2 * t, LEASE_CAP) if vacuum else t)


@dataclass(frozen=True)
class Policy:
    """When a commit triggers maintenance: never, always (probability 1, threshold 0), or by chance and number of pending files."""

    compact_probability: float = 0.0
    compact_threshold: int = 0
    vacuum_probability: float = 0.0
    vacuum_after_compact_probability: float = 0.0

    def compacts(self, pending_files: int, rng: random.Random) -> bool:
        return rng.random() < self.compact_probability and pending_files >= self.compact_threshold

    def vacuums(self, compacted_now: bool, rng: random.Random) -> bool:
        return rng.random() < self.vacuum_probability or (compacted_now and rng.random() < self.vacuum_after_compact_probability)


# The usual policy.
DEFAULT_POLICY = Policy(0.1, 5, 0.01, 0.1)
ALWAYS = Policy(1.0, 0, 0.0, 0.0)
NEVER = Policy()
