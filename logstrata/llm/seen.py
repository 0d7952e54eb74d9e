"""Has this key been seen before? Exactly, over a stream, with every seen key in disk-backed state of its own.

Records are partitioned by the 128-bit print of their key. A streaming aggregation keeps, per key, the smallest record number so
far and how often the key came; its state is in RocksDB on the executors' disks and checkpointed to the shared folder with every
batch, so a lost executor loses nothing. There is no watermark: a key is remembered for good. All of that runs in the JVM, and a
batch reads and writes the state of the keys that arrive in it, however many others are remembered.

A batch emits the first record of each key that it touched. A record is a repeat if its number is above its key's first; as
records arrive out of order, that is decided by the last first emitted. Equal keys are combined before the state's shuffle, so a
key with a third of all rows sends one row per task to its state. Where the records meet their firsts, keys that make up a
thousandth of all rows or more, so a thousand at most, are broadcast, and their records stay where they are; the others are joined
by key.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Hdfs, materialize, scratch_path

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key is hot if it makes up one of so many parts of all rows; as many keys can be hot at most.
HOT = 1000
_FIRSTS = "a bigint, b bigint, first bigint, times bigint"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def prints(records: DataFrame) -> DataFrame:
    """``(a, b, rec_no)``: the 128-bit print of the key (collection, id) of each record with a number.

    The hashed text differs for different (collection, id), nulls included, which are keys like any other.
    """
    key = F.concat(
        F.coalesce(F.concat(F.length("collection").cast("string"), F.lit(":"), F.col("collection")), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("="), F.col("id")), F.lit("-"))
    )
    return records.where("rec_no IS NOT NULL").select(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"), F.col("rec_no").cast("bigint").alias("rec_no"))


def remember(spark: SparkSession, path: str, out: str, checkpoint: str, max_bytes_per_trigger: int = 8 << 30) -> list[dict]:
    """Take the files of the Parquet folder ``path`` that ``checkpoint`` hasn't seen into the state, in batches of about
    ``max_bytes_per_trigger``, and write the firsts of the keys each batch touches to ``out``. Returns the progress of each batch.

    A batch that is repeated after a failure replaces what it wrote.
    """
    schema = spark.read.parquet(path).select("collection", "id", "rec_no").schema

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _settings(
        spark,
        {
            "spark.sql.streaming.stateStore.providerClass": _ROCKS,
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        },
    ):
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(_as_stream_path(spark, path))
        firsts = prints(source).groupBy("a", "b").agg(F.min("rec_no").alias("first"), F.count(F.lit(1)).alias("times"))
        query = firsts.writeStream.foreachBatch(emit).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [dict(p) for p in query.recentProgress]


def firsts_of(spark: SparkSession, out: str) -> DataFrame:
    """``(a, b, first, times)``, one row for each key remembered in ``out``: what was emitted of it last."""
    if not any(name.startswith("batch=") for name, _ in Hdfs(spark, out).files(out)):
        return spark.createDataFrame([], _FIRSTS)
    emitted = spark.read.schema(_FIRSTS).option("basePath", out).parquet(f"{out}/batch=*")
    return emitted.groupBy("a", "b").agg(F.min("first").alias("first"), F.max("times").alias("times"))


def later_than_first(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(rec_no)`` of the rows of `prints` that are above the first of their key."""
    total = firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = firsts.where(F.col("times") * HOT >= total).select("a", "b", F.col("first").alias("hot"))
    met = keyed.join(F.broadcast(hot), ["a", "b"], "left")  # HOT rows at most
    direct = met.where(F.col("rec_no") > F.col("hot")).select("rec_no")
    rest = met.where(F.col("hot").isNull()).select("a", "b", "rec_no").join(firsts.where(F.col("times") * HOT < total).select("a", "b", "first"), ["a", "b"])
    return direct.unionByName(rest.where(F.col("rec_no") > F.col("first")).select("rec_no"))


def repeats(spark: SparkSession, path: str, out: str | None = None, checkpoint: str | None = None, max_bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """``(rec_no bigint)`` of every row of the Parquet folder ``path`` whose (collection, id) has a row of smaller rec_no.

    Keys are told apart by 128 bits of hash: among a billion keys two that are confused are less likely than 1 in 10^20.

    Called again with the same ``out`` and ``checkpoint``, only new files are taken into the state, and the answers are those
    for all rows of ``path`` against everything remembered, also from files that are gone since. By default both are new folders
    of the shared one.

    Rows without rec_no have no place in the order and give no answer; a null collection or id is a key like any other. Rows
    that repeat the smallest rec_no aren't repeats, as nothing smaller precedes them; other rows answer once each. An empty
    table gives no rows, and columns besides the three aren't read.
    """
    out = out or scratch_path(spark, "firsts")
    checkpoint = checkpoint or scratch_path(spark, "firsts-state")
    remember(spark, path, out, checkpoint, max_bytes_per_trigger)
    return later_than_first(prints(spark.read.parquet(path)), materialize(firsts_of(spark, out), "firsts-of"))


def _as_stream_path(spark: SparkSession, path: str) -> str:
    """A file stream reads a folder; a single file is named by a pattern that only it matches."""
    fs = Hdfs(spark, path)
    if fs._fs.getFileStatus(fs._path).isFile():
        return path[:-1] + "[" + path[-1] + "]"
    return path


def error_rates(records: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """Per collection: rows, repeats reported, answers that are wrong and their rate, and the state of the collection's filter.

    The truth is computed apart from the stream, by one aggregation of the smallest rec_no per key. ``bloom_filter_built`` is
    that of the collection's last run (by started_at, then run_no) with a flag that isn't null; false without one. Rows
    without rec_no have no answer and aren't counted.
    """
    rows = records.where("rec_no IS NOT NULL").select("collection", "id", "rec_no")
    first = rows.groupBy(F.col("collection").alias("c"), F.col("id").alias("i")).agg(F.min("rec_no").alias("first"))
    same = F.col("collection").eqNullSafe(F.col("c")) & F.col("id").eqNullSafe(F.col("i"))
    truth = rows.join(first, same).select("collection", "rec_no", (F.col("rec_no") > F.col("first")).alias("truth"))
    said = found.distinct().withColumn("said", F.lit(True))
    judged = truth.join(said, "rec_no", "left").select("collection", "truth", F.coalesce("said", F.lit(False)).alias("said"))
    counted = judged.groupBy("collection").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("said").alias("repeats"), F.count_if(F.col("said") != F.col("truth")).alias("wrong")
    )
    built = (
        runs.where("bloom_filter_built IS NOT NULL").groupBy(F.col("collection").alias("c"))
        .agg(F.max_by("bloom_filter_built", F.struct("started_at", "run_no")).alias("built"))
    )
    return counted.join(built, F.col("collection").eqNullSafe(F.col("c")), "left").select(
        "collection", "rows", "repeats", "wrong", (F.col("wrong") / F.col("rows")).alias("wrong_rate"), F.coalesce("built", F.lit(False)).alias("bloom_filter_built")
    )
