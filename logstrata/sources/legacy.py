"""Reading a document log kept as JSON text files: a main file of lines and pending files of arrays."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import as_of
from ..runtime import Hdfs

# The names of a collection's files, and the folder listing of a catalog.
PENDING = r"\.mutation\.([0-9]+)-"
COLLECTION = r"^([^.]+)\."

#: Milliseconds that a file's name may be later than the time of its records: they are stamped before the file is named and written.
STAMP_AHEAD = 60_000

SCHEMA = "id string, deleted boolean, ts bigint, ord struct<src:int,file:string,block:bigint,row:bigint,pos:int>, data variant"


def read_log(spark: SparkSession, folder: str, collection: str, at: int | None = None) -> DataFrame:
    """All stored versions of ``collection`` in ``folder`` as a log whose document is the VARIANT column ``data``.

    The order of storage is that of the main file's lines, then of the pending files by name, then of the places in a file.
    Blank and malformed lines, malformed files and records that are no array of two or more are passed over. ``data`` null is a
    deletion; a ts that is missing or no number is null. A folder without such files gives no rows.

    With ``at``, versions of that time or before. A pending file is named after its records were stamped, so what its name says is
    no bound from above; but files come in order, and a writer's stamps rise by steps of a call. Files named more than STAMP_AHEAD
    after ``at`` aren't opened.
    """
    names = [n for n, _ in Hdfs(spark, folder).files(folder)]
    parts = []
    record = F.col("r")
    tail = [
        F.try_variant_get(record, "$[0]", "string").alias("id"),
        F.coalesce(F.is_variant_null(F.try_variant_get(record, "$[1]", "variant")), F.lit(True)).alias("deleted"),
        F.try_variant_get(record, "$[2]", "bigint").alias("ts"),
    ]
    if f"{collection}.jsonl" in names:
        lines = spark.read.text(f"{folder}/{collection}.jsonl").select(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.try_parse_json("value").alias("r")
        )
        order = F.struct(F.lit(0).alias("src"), F.lit("").alias("file"), "block", "row", F.lit(0).alias("pos"))
        parts.append(lines.where(_is_record(record)).select(*tail, order.alias("ord"), F.try_variant_get(record, "$[1]", "variant").alias("data")))
    pending = [n for n in names if n.startswith(f"{collection}.mutation.") and (at is None or not _later(n, at))]
    if pending:
        whole = spark.read.text([f"{folder}/{n}" for n in pending], wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
        each = whole.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "r"))
        order = F.struct(F.lit(1).alias("src"), "file", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"), "pos")
        parts.append(each.where(_is_record(record)).select(*tail, order.alias("ord"), F.try_variant_get(record, "$[1]", "variant").alias("data")))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return as_of(out, at)


def _later(name: str, at: int) -> bool:
    """Whether a pending file was named so long after ``at`` that its records can't be of that time."""
    found = re.search(PENDING, name)
    return found is not None and int(found[1]) > at + STAMP_AHEAD


def _is_record(r):
    second = F.try_variant_get(r, "$[1]", "variant")
    return F.schema_of_variant(r).startswith("ARRAY") & F.try_variant_get(r, "$[0]", "string").isNotNull() & second.isNotNull()


def list_collections(spark: SparkSession, folder: str) -> list[str]:
    """The names of all collections with a file in ``folder``, sorted."""
    return sorted({m[1] for n, _ in Hdfs(spark, folder).files(folder) if (m := re.match(COLLECTION, n))})


def count_pending_files(spark: SparkSession, folder: str, collection: str) -> int:
    return sum(n.startswith(f"{collection}.mutation.") for n, _ in Hdfs(spark, folder).files(folder))
