"""Exact top-k search over the current vectors of a log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidVectorError, VectorDimensionError
from ..functions import vectors as V
from ..functions.predicates import Where, where_column
from .state import current_state

# The metrics, and whether a higher score is better.
METRICS = {"cosine": True, "euclidean": False, "dotProduct": True}
#: Results of a search request: by default, and at most.
REQUESTED, MOST_REQUESTED = 10, 100
#: Documents of a block of `search_many`, about.
BLOCK_ROWS = 16_384
#: Decimals by which scores are ranked, so that ties don't depend on the order of addition.
DECIMALS = 6


def check_vector(vector, dimension: int) -> list[float]:
    """``vector`` as floats, or an exception."""
    if not isinstance(vector, list | tuple):
        raise InvalidVectorError("a vector is an array")
    if len(vector) != dimension:
        raise VectorDimensionError(dimension, len(vector))
    for x in vector:
        if isinstance(x, bool) or not isinstance(x, int | float) or x != x or abs(x) == float("inf"):
            raise InvalidVectorError("a vector has finite numbers only")
    return [float(x) for x in vector]


def request_size(k) -> int:
    """The k of a request: a whole number from 1, at most MOST_REQUESTED; none or 0 is REQUESTED."""
    if not k:
        return REQUESTED
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k is a whole number")
    return min(k, MOST_REQUESTED)


def score(metric: str, vector: Column, query: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    of = {"cosine": V.cosine, "euclidean": V.euclidean, "dotProduct": V.dot}[metric]
    return F.round(of(vector, query), DECIMALS)


def _kept(metric: str, threshold: float | None) -> Column:
    if threshold is None:
        return F.lit(True)
    return F.col("score") >= threshold if METRICS[metric] else F.col("score") <= threshold


def search(log: DataFrame, query: list[float], dimension: int, k: int | None = 10, metric: str = "cosine", threshold: float | None = None, where: Where = None,
           now: int | None = None, ttl: str | None = None, include_vector: bool = False, vector: str = "vector") -> DataFrame:
    """``(id, score, ...)``: the ``k`` best current documents, best first, ties by id.

    cosine is the true cosine, 0 for an all-zero vector. ``threshold`` is inclusive. ``where`` is applied before scoring. Stored
    vectors that are null, of another length or not finite are passed over. Each task keeps its own k best; k rows are merged.
    """
    q = check_vector(query, dimension)
    docs = current_state(log, None, now, ttl)
    docs = docs.where(where_column(docs, where)).where(V.is_valid(vector, dimension))
    scored = docs.withColumn("score", score(metric, F.col(vector), V.literal(q))).where(_kept(metric, threshold)).drop("deleted", "ts", "ord")
    scored = scored if include_vector else scored.drop(vector)
    ordered = scored.orderBy(F.desc("score") if METRICS[metric] else F.asc("score"), "id")
    return ordered if k is None else ordered.limit(k)


def search_many(docs: DataFrame, queries: DataFrame, dimension: int, k: int = 10, metric: str = "cosine", vector: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, id, score, rank)`` of a stated set of queries ``(query_id, query)`` against all ``docs`` with ``id`` and ``vector``.

    Documents are cut into blocks of about ``block_rows`` by the hash of their id, and each query is sent to each block. A task holds
    one block and multiplies it with the queries that stream past, so neither side has to fit into a task; it keeps the k best of each
    query and those that tie with the last, and they are merged. Vectors that aren't valid are passed over.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    spark = docs.sparkSession
    valid = docs.where(F.col("id").isNotNull() & V.is_valid(vector, dimension))
    blocks = max(1, -(-valid.count() // block_rows))
    d = valid.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), F.col("id").cast("string").alias("name"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(F.col("query_id").isNotNull() & V.is_valid("query", dimension)).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), F.col("query_id").cast("string").alias("name"), F.col("query").cast("array<double>").alias("v"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 4096))
    together = d.unionByName(q).repartition(parts, "block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, held, block = None, [], [], None
        for b in batches:
            number, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            turn = np.flatnonzero((np.diff(number) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(number)]):
                if lo == hi:
                    continue
                if number[lo] != at:
                    at, names, held, block = number[lo], [], [], None
                part = b.slice(lo, hi - lo)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                if role[lo] == 0:
                    names += part.column(2).to_pylist()
                    held.append(x)
                elif held:
                    block = np.concatenate(held) if block is None else block
                    yield from _best_of_block(part.column(2).to_pylist(), x, names, block, k, metric)

    found = together.mapInArrow(run, "query_id string, id string, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if METRICS[metric] else F.asc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of_block(asked: list[str], queries: np.ndarray, names: list[str], block: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 21) // len(names))
    lengths = np.sqrt((block * block).sum(1))
    for i in range(0, len(asked), step):
        q = queries[i : i + step]
        if metric == "euclidean":
            s = np.stack([np.sqrt(((block - x) ** 2).sum(1)) for x in q])
        else:
            s = q @ block.T
            if metric == "cosine":
                both = np.sqrt((q * q).sum(1))[:, None] * lengths[None, :]
                s = np.divide(s, both, out=np.zeros_like(s), where=both > 0)
        s = np.round(s, DECIMALS)
        better = s if METRICS[metric] else -s
        bar = np.partition(better, len(names) - k, axis=1)[:, len(names) - k] if len(names) > k else np.full(len(q), -np.inf)
        row, col = np.nonzero(better >= bar[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array([asked[i + r] for r in row], pa.string()), pa.array([names[c] for c in col], pa.string()), pa.array(s[row, col])], names=["query_id", "id", "score"])
