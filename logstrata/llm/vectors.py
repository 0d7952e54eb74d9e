"""What the vector operators share: current usable vectors, packing, coarse cells and tasks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize

DIMENSION = 64
#: Vectors of the sample that cells are fitted on, at least, and for each cell; their bytes are what comes to the driver (8 MB and,
#: with MAX_CELLS, 64 MB at 64 dimensions).
FIT_SAMPLE, FIT_PER_CELL = 16_384, 16
#: Vectors that one block of a cell holds at most, about; a cell of any size is cut into such blocks.
BLOCK_ROWS = 16_384
#: Cells aimed at: one for so many vectors, up to the limit, whose centroids are broadcast (4 MB at 64 dimensions).
ROWS_PER_CELL, MAX_CELLS = 512, 8192


def current_vectors(versions: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """``(id string, vector array<double>)``: the vector of the highest ``ver`` of each id, where it's usable.

    Usable: exactly ``dimension`` elements, all finite and not null, not all zero. An id whose highest version has no usable
    vector isn't replaced by an older one. Rows without id are left out, a null ver is below all others; among rows of one
    ver the largest vector counts, so repeated rows change nothing. Expiry isn't regarded.
    """
    latest = (
        versions.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(F.struct("ver", F.col("vector").cast("array<double>").alias("vector"))).alias("v"))
        .select("id", "v.vector")
    )
    big = F.lit(float("inf"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("vector", lambda x: x != 0)
    return latest.where((F.size("vector") == dimension) & fine)


def current_texts(versions: DataFrame) -> DataFrame:
    """``(id, text)`` of the highest ``ver`` of each id; among rows of one ver the largest text counts. A text may be null."""
    latest = versions.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("ver", "text")).alias("v"))
    return latest.select("id", F.col("v.text").alias("text"))


def unit_rows(column: pa.ListArray | pa.ChunkedArray, dimension: int = DIMENSION) -> np.ndarray:
    """The vectors of an Arrow list column, scaled to length 1. Scaled by their largest element first, against overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(df: DataFrame, dimension: int = DIMENSION, kind: type = np.float32) -> DataFrame:
    """``(id, vec binary)``: unit vectors as floats of ``kind``, from ``(id, vector)``.

    They are scaled in double precision and rounded then. 4-byte floats halve what is shuffled, but move a similarity by some
    3e-8, a thirtieth of the last of the 6 decimals that count; where similarities are told, 8-byte ones are used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = np.ascontiguousarray(unit_rows(b.column(1), dimension).astype(kind))
                yield pa.RecordBatch.from_arrays([b.column(0), as_binary(u)], names=["id", "vec"])

    return df.select("id", "vector").mapInArrow(run, "id string, vec binary")


def as_binary(u: np.ndarray) -> pa.Array:
    width = u.shape[1] * u.itemsize
    offsets = np.arange(len(u) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(u))])


def from_binary(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a binary column without nulls, as they lie in its buffer."""
    if not len(column):
        return np.empty((0, dimension), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    start, width = int(offsets[column.offset]), int(offsets[column.offset + 1] - offsets[column.offset])
    kind = np.float64 if width == 8 * dimension else np.float32
    return np.frombuffer(column.buffers()[2], np.uint8, width * len(column), start).view(kind).reshape(-1, dimension)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(rid bigint, head, vec, n, m1, m2)``, written: the distinct vectors of `packed` rows, with the smallest id of each and how
    many have it. rid is in the order of head; (m1, m2) are 128 bits of hash, by which equal vectors are recognised."""
    grouped = rows.groupBy("m1", "m2").agg(F.min("id").alias("head"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"))
    return materialize(grouped.orderBy("head").select(F.monotonically_increasing_id().alias("rid"), "head", "vec", "n", "m1", "m2"), "heads")


def marked(vectors: DataFrame, dimension: int = DIMENSION, kind: type = np.float32) -> DataFrame:
    """``(id, vec, m1, m2)``, written."""
    return materialize(packed(vectors, dimension, kind).select("id", "vec", F.xxhash64("vec").alias("m1"), F.xxhash64(F.lit(1), "vec").alias("m2")), "vectors")


def fit_sample(vectors: DataFrame, rows: int = FIT_SAMPLE, dimension: int = DIMENSION) -> np.ndarray:
    """A sample of ``(id, vec)`` of at most ``rows`` rows, drawn by the hash of the id, so the same in every run."""
    got = vectors.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows).select("vec").toArrow()
    if got.num_rows == 0:
        return np.empty((0, dimension), np.float32)
    return from_binary(got.column(0).combine_chunks(), dimension)


def cell_count(rows: int, rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS) -> int:
    return int(min(max_cells, max(1, rows // rows_per_cell)))


def spherical_kmeans(sample: np.ndarray, k: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of a sample that fits the driver."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(steps):
        nearest = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def with_cells(vectors: DataFrame, centroids: np.ndarray, margin: float, dimension: int = DIMENSION) -> DataFrame:
    """``(id bigint, vec, cell int, probes array<int>)``: the nearest centroid, and all cells whose border to it is within ``margin``.

    The distance of a unit vector v to the border between its own cell c and another d is (v.c - v.d) / |c - d|. Of two vectors
    at distance e in different cells, one is within e / 2 of the border; as e lies in no special direction to the border's
    normal, a margin of about 2 e / sqrt(dimension) already holds nearly all pairs, and e / 2 all.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        step = max(64, (1 << 21) // len(c))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                u = from_binary(part.column(1), dimension)
                near = u @ c.T
                cell = near.argmax(1)
                own = near[np.arange(len(u)), cell]
                gap = np.sqrt(np.maximum(2 - 2 * (c[cell] @ c.T), 1e-12))
                within = (own[:, None] - near) <= margin * gap
                within[np.arange(len(u)), cell] = True
                row, probe = np.nonzero(within)
                ends = np.searchsorted(row, np.arange(len(u) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(probe.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), lists], names=["id", "vec", "cell", "probes"])

    return vectors.select("id", "vec").mapInArrow(run, "id bigint, vec binary, cell int, probes array<int>")


def meet_in_blocks(celled: DataFrame, work: Callable, schema: str, block_rows: int = BLOCK_ROWS, dimension: int = DIMENSION) -> DataFrame:
    """Let every vector, as a query, meet all vectors of the cells that it probes.

    A cell's vectors are cut into blocks of about ``block_rows``, so that a cell with a third of all rows becomes many tasks. A
    query goes to each block of its probed cells; within a task the block's vectors come first and the queries stream past them,
    so a task holds one block however many queries there are. ``work(block_ids, block_vectors)`` returns an object with
    ``query(ids, vectors)`` and ``close()``, both yielding Arrow batches of ``schema``.
    """
    spark: SparkSession = celled.sparkSession
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int").alias("blocks"))
    counts = sizes.collect()  # one row per cell
    if not counts:
        return spark.createDataFrame([], schema)
    blocks = spark.createDataFrame([(r[0], r[1]) for r in counts], "cell int, blocks int")
    base = celled.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "id", "vec")
    asked = (
        celled.select("id", "vec", F.explode("probes").alias("cell"))
        .join(F.broadcast(blocks), "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "vec")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * sum(r[1] for r in counts), 4096) // 8)
    together = base.unionByName(asked).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, task = None, [], None
        for b in batches:
            cells, numbers, roles = (b.column(i).to_numpy() for i in range(3))
            turn = np.flatnonzero((np.diff(cells) != 0) | (np.diff(numbers) != 0) | (np.diff(roles) != 0)) + 1
            for lo, hi in zip([0, *turn.tolist()], [*turn.tolist(), len(cells)]):
                if lo == hi:
                    continue
                if at != (cells[lo], numbers[lo]):
                    if task is not None:
                        yield from task.close()
                    at, held, task = (cells[lo], numbers[lo]), [], None
                part = b.slice(lo, hi - lo)
                ids, vectors = part.column(3).to_numpy(), from_binary(part.column(4), dimension)
                if roles[lo] == 0:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue  # a block that the hash left empty
                if task is None:
                    task = work(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                yield from task.query(ids, vectors)
        if task is not None:
            yield from task.close()

    return together.mapInArrow(run, schema)
