"""The state of a document log: the latest version per id, as of now or of any time, without deleted and expired documents.

A log is a DataFrame with ``id``, ``deleted boolean``, ``ts bigint`` (epoch-ms, may be null) and ``ord`` (any orderable column
that is unique per id: the order in which versions were stored), besides the columns of the document. The last version in
order of ``ord`` wins, never that of the highest ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("id", "deleted", "ts", "ord")


def from_changes(df: DataFrame, id: Column, ts: Column, ord: Column, delete_when: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Any table of changes as a log. ``keep`` names the document's columns, by default all; names of META are replaced."""
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c not in META]
    deleted = F.coalesce(delete_when, F.lit(False)) if delete_when is not None else F.lit(False)
    return df.select(id.cast("string").alias("id"), deleted.alias("deleted"), ts.alias("ts"), ord.alias("ord"), *kept)


def as_of(log: DataFrame, at: int | None) -> DataFrame:
    """Versions of time ``at`` or before; versions without ts were always there. The filter reaches the scan."""
    return log if at is None else log.where(F.col("ts").isNull() | (F.col("ts") <= at))


def latest(log: DataFrame) -> DataFrame:
    """The last version of each id, deletions included.

    row_number() = 1 becomes a group limit that runs before the shuffle too, so a hot id sends one row per task. Rows without id
    are no versions of a document and are left out. Of versions with equal ``ord`` the one of the higher ts, then the deletion
    wins.
    """
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("ord"), F.desc_nulls_last("ts"), F.desc("deleted"))
    return log.where(F.col("id").isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def not_expired(now: int | None, ttl: str | None) -> Column:
    """Expired is what has a ttl below ``now``; null and a ttl of exactly ``now`` aren't."""
    return F.lit(True) if now is None or ttl is None else F.coalesce(F.col(ttl) >= now, F.lit(True))


def current_state(log: DataFrame, at: int | None = None, now: int | None = None, ttl: str | None = None) -> DataFrame:
    """Live documents: as of ``at``, not deleted, and not expired by column ``ttl`` (epoch-ms) at ``now``."""
    return latest(as_of(log, at)).where(~F.col("deleted")).where(not_expired(now, ttl))


def with_first_seen(log: DataFrame, at: int | None = None, now: int | None = None, ttl: str | None = None) -> DataFrame:
    """`current_state` with ``first_seen``, the least ``ord`` of the id: the order in which documents are listed and paged.

    One aggregation that combines on the map side. A deletion doesn't take an id out of its place.
    """
    rows = as_of(log, at).where(F.col("id").isNotNull())
    rest = [c for c in log.columns if c not in ("id", "first_seen")]  # a column of that name gives way
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    order = F.struct("ord", F.col("ts"), F.col("deleted"))
    one = rows.groupBy("id").agg(F.min("ord").alias("first_seen"), F.max_by(whole, order).alias("v"))
    flat = one.select("id", *[F.col(f"v.`{c}`").alias(c) for c in rest], "first_seen")
    return flat.where(~F.col("deleted")).where(not_expired(now, ttl))


def expired(log: DataFrame, now: int, ttl: str) -> DataFrame:
    """Live documents whose ttl has passed: those that a clean-up deletes."""
    return latest(log).where(~F.col("deleted")).where(F.col(ttl) < now)


def expiry_tombstones(log: DataFrame, now: int, ttl: str, ord: Column) -> DataFrame:
    """The deletions that a clean-up appends, with the columns of ``log``; those of the document are null."""
    gone = expired(log, now, ttl).select("id")
    kinds = dict(log.dtypes)
    fill = {"id": F.col("id"), "deleted": F.lit(True), "ts": F.lit(now).cast("bigint"), "ord": ord}
    return gone.select(*[fill[c].cast(kinds[c]).alias(c) if c in fill else F.lit(None).cast(kinds[c]).alias(c) for c in log.columns])


def count_live(log: DataFrame, at: int | None = None, now: int | None = None, ttl: str | None = None) -> DataFrame:
    """One row ``(n)``."""
    return current_state(log, at, now, ttl).agg(F.count(F.lit(1)).alias("n"))


def count_timeline(log: DataFrame, times: list[int]) -> DataFrame:
    """``(as_of_ms, n)``: live documents at each time, in one pass.

    Every version is alive from its own place to that of its next version, but as the order of storage and of time may differ,
    each time keeps the last stored version among those it may see: one maximum per id and time, combined before the shuffle.
    """
    grid = F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in times]))
    seen = log.where(F.col("id").isNotNull()).select("id", "deleted", "ts", "ord", grid.alias("as_of_ms")).where(F.col("ts").isNull() | (F.col("ts") <= F.col("as_of_ms")))
    last = seen.groupBy("as_of_ms", "id").agg(F.max_by("deleted", F.struct("ord", "ts", "deleted")).alias("deleted"))
    live = last.groupBy("as_of_ms").agg(F.count_if(~F.col("deleted")).alias("n"))
    all_times = log.sparkSession.createDataFrame([(int(t),) for t in dict.fromkeys(times)], "as_of_ms bigint")
    return all_times.join(live, "as_of_ms", "left").select("as_of_ms", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
