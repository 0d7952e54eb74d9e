"""Structured Streaming into a collection: every micro-batch is one commit, applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, deleted: str | None = None, order: str | None = None, available_now: bool = True,
           name: str | None = None) -> StreamingQuery:
    """Append a stream of documents (``id`` and any columns) to ``collection``; rows whose column ``deleted`` is true delete.

    A micro-batch is one commit. Of several rows of one id in it the one highest in the column ``order`` counts (of equal ones the
    deletion), so that a put after a deletion stays. Without ``order`` a batch has none but that of its rows in its partitions: give
    one where an id can come twice. The collection keeps the number of the last batch of each stream, by ``name`` or else by the
    path of the checkpoint, so a batch that is repeated after a failure isn't applied again.
    """
    known = name or checkpoint

    def write(batch: DataFrame, number: int) -> None:
        gone = F.col(deleted) if deleted else None
        collection.write_df(batch, gone, F.col(order) if order else None, (known, number))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts per window and keys over an event stream; rows later than ``lateness`` are left out, and state is dropped then."""
    return (
        stream.withWatermark(time, lateness).groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
    )
