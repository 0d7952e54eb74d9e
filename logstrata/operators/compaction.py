"""Many small log files into few well-sized ones, each record once.

Method: the records are range-partitioned by the clustering columns with boundaries that Spark samples, into as many parts as
the target size asks for, sorted within each part and written; counts and a checksum are reconciled per collection between
what was to be kept and what was written, and only then the folders are swapped.

Plan: the bodies are parsed once and the records written. The kept copy of equal records is found by an aggregation with map-side
combine over a 128-bit hash and the place (a record that makes up a third of all rows shuffles one row per task), and a semi-join by
places takes the kept records. The range columns end in (object_key, pos), which are unique, so no clustering value can overfill
one part. Nothing but totals comes to the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Hdfs, materialize
from ..sources.objects import OBJECT_KEY, RECORD_SCHEMA, object_records

CLUSTERING = ("volume", "collection", "id", "ts", "object_key", "pos")
#: Written bytes of one file that are aimed at.
TARGET_BYTES = 256 * 1024 * 1024


def kept_copies(records: DataFrame) -> DataFrame:
    """``(print, object_key, pos, copies, bytes)``: for equal records the one with the smallest (object_key, pos), how many there are
    and the bytes of its text."""
    size = (F.length("data") + F.length("id") + 40).alias("bytes")
    first = records.select("print", F.struct("object_key", "pos").alias("place"), size).groupBy("print").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("bytes"))
    return first.select("print", "first.object_key", "first.pos", "copies", "bytes")


def left_out_copies(objects: DataFrame, pages: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``(object_key, pos)`` of every stored copy of a record that compaction into ``out`` leaves out: those that aren't in its files.

    Of equal records (volume, collection, id, ts and data as JSON values) the copy with the smallest (object_key, pos) stays.
    Empty tables, null keys and null bodies give no rows. Should ``objects`` hold the same object_key twice, its rows count as
    one object if their bodies agree, since the same (object_key, pos) is then the kept one.
    """
    _, records = consolidate(objects, pages, out, target_bytes)
    written = objects.sparkSession.read.schema(RECORD_SCHEMA).parquet(out).select("object_key", "pos")
    return records.select("object_key", "pos").join(written, ["object_key", "pos"], "left_anti")


@dataclass(frozen=True)
class CompactionReport:
    files_in: int
    records_in: int
    records_kept: int
    records_left_out: int
    files_out: int
    bytes_out: int


class CountMismatch(RuntimeError):
    """What was written isn't what was to be kept; nothing was swapped."""


def _ledger(df: DataFrame) -> DataFrame:
    """(volume, collection, n, x): count and checksum of the records of each collection."""
    named = df.select(*[F.regexp_extract("object_key", OBJECT_KEY, i + 1).alias(c) for i, c in enumerate(("volume", "collection"))], F.xxhash64("print", "object_key", "pos").alias("h"))
    return named.groupBy("volume", "collection").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"))


def _mismatches(expected: DataFrame, found: DataFrame) -> int:
    """Collections whose count or checksum differs."""
    theirs = found.select("volume", "collection", F.col("n").alias("n2"), F.col("x").alias("x2"))
    both = expected.join(theirs, ["volume", "collection"], "full")
    return both.where(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("x").eqNullSafe(F.col("x2")))).count()


def swap_folders(fs: Hdfs, staged: str, current: str) -> None:
    """Put ``staged`` in the place of ``current``. A crash in between leaves ``current`` or ``current.old``, see `recover`."""
    old = f"{current}.old"
    recover(fs, current)
    if fs.exists(current):
        fs.rename(current, old)
    fs.rename(staged, current)
    fs.delete(old)


def recover(fs: Hdfs, current: str) -> None:
    """Undo or finish a swap that was cut short."""
    old = f"{current}.old"
    if fs.exists(old):
        if fs.exists(current):
            fs.delete(old)
        else:
            fs.rename(old, current)


def consolidate(objects: DataFrame, pages: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> tuple[CompactionReport, DataFrame]:
    """`compact_small_files`, and the table of all stored records that it took in, with columns RECORD_SCHEMA."""
    spark: SparkSession = objects.sparkSession
    records = materialize(object_records(objects, pages), "records")
    keepers = materialize(kept_copies(records), "keepers")
    zero = F.lit(0).cast("bigint")
    totals = keepers.agg(F.coalesce(F.sum("copies"), zero).alias("n"), F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("bytes"), zero).alias("b")).first()
    place = ["print", "object_key", "pos"]
    kept = records.join(keepers.select(*place), place, "left_semi").dropDuplicates(place).select(*records.columns)
    parts = max(1, -(-totals["b"] // (3 * target_bytes)))
    staged = f"{out}.staged-{uuid.uuid4().hex}"
    kept.repartitionByRange(parts, *CLUSTERING).sortWithinPartitions(*CLUSTERING).write.parquet(staged)
    fs = Hdfs(spark, out)
    written = spark.read.schema(records.schema).parquet(staged)
    if wrong := _mismatches(_ledger(keepers), _ledger(written)):
        found = written.count()
        fs.delete(staged)
        raise CountMismatch(f"{wrong} collections differ between what was to be kept, {totals['k']} records, and what was written, {found}")
    swap_folders(fs, staged, out)
    files = [size for name, size in fs.files(out) if name.endswith(".parquet")]
    taken = records.select("object_key").distinct().count()
    return CompactionReport(taken, totals["n"], totals["k"], totals["n"] - totals["k"], len(files), sum(files)), records


def compact_small_files(objects: DataFrame, pages: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> CompactionReport:
    """Consolidate the records of the listed objects into Parquet files of about ``target_bytes`` in the folder ``out``.

    The files hold RECORD_SCHEMA, sorted by CLUSTERING, each record once. The number of files follows from the bytes of
    the records (a third of their text, as Parquet compresses them about so). An empty input gives an empty folder that can
    be read. Raises `CountMismatch`, with ``out`` untouched, if the written rows differ from those to be kept.
    """
    return consolidate(objects, pages, out, target_bytes)[0]
