"""The k most similar vectors for every vector, by randomly rotated one-bit codes.

Vectors are assigned to coarse cells fitted on a bounded sample; every vector is indexed, and every vector asks. Within a block of
a cell both sides are taken relative to the block's mean, rotated at random and reduced to the signs of their coordinates, packed
into 64-bit words. With s the inner product of a unit residual and its own code, the inner product of two residuals is estimated
as

    |a| |b| (1 - 2 hamming / bits) / (s_a s_b),

and its error is about |a| |b| sqrt((1/s_a^2 - 1 + 1/s_b^2 - 1) / (bits - 1)). A vector is compared exactly if the estimate plus
EPSILON errors reaches the k-th best exact similarity so far (and the least similarity asked for); the others can't matter
within that confidence.

The loss is twofold: pairs in cells that aren't probed, and estimates wrong by more than EPSILON errors. `recall` measures both
against brute force. Only pairs of PROBED_LEAST or more lie within the probed band; the neighbours of a vector that is like no other
lie in any cell. So below that limit all vectors ask all blocks, which is a number of comparisons quadratic in the vectors; where the
codes leave much of a block to compare, it's compared exactly as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .vectors import (
    BLOCK_ROWS, DIMENSION, FIT_PER_CELL, FIT_SAMPLE, MAX_CELLS, ROWS_PER_CELL, cell_count, distinct_vectors, fit_sample, marked, meet_in_blocks, packed,
    spherical_kmeans, with_cells,
)

#: Words of 64 bits per code; errors allowed for; width of the band around a cell in which its neighbours are asked too.
WORDS, EPSILON, MARGIN = 2, 3.0, 0.08
#: Least similarity that MARGIN is sized for.
PROBED_LEAST = 0.94
#: Decimals of a similarity, by which vectors are ranked; ties go to the smaller id.
DECIMALS = 6
#: Vectors for which recall is measured.
RECALL_QUERIES = 1000
#: Comparisons of one tile, which bound the memory of a step.
_TILE = 1 << 21


def rotation(dimension: int, words: int, seed: int = 17) -> np.ndarray:
    """``dimension`` x 64 * words: orthonormal rows or columns, blockwise, from a fixed seed."""
    rng = np.random.default_rng(seed)
    bits = 64 * words
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:
        blocks.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0])
    return np.concatenate(blocks, axis=1)[:, :bits]


class Codes:
    """One-bit codes of vectors relative to a centre, with their correction scalars."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        r = vectors - centre
        self.length = np.sqrt((r * r).sum(1))
        y = (r @ turn) / np.maximum(self.length, 1e-12)[:, None]
        bits = turn.shape[1]
        # the code is sign(y) / sqrt(bits); y is scaled to length 1 among the bits
        y *= np.sqrt(turn.shape[0] / bits)
        self.fit = np.maximum(np.abs(y).sum(1) / np.sqrt(bits), 0.05)
        self.spread = 1 / (self.fit * self.fit) - 1
        self.words = np.packbits(y > 0, axis=1).view(np.uint64)
        self.along = vectors @ centre


class Searcher:
    """One block of one cell; finds for each query its k best of the block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, least: float, words: int, epsilon: float):
        order = np.argsort(ids)
        self.names = ids[order]
        self.vectors = vectors[order].astype(np.float64)
        self.k, self.least, self.epsilon = k, least, epsilon
        self.turn = rotation(vectors.shape[1], words)
        self.centre = self.vectors.mean(0)
        self.square = float(self.centre @ self.centre)
        self.codes = Codes(self.vectors, self.centre, self.turn)

    def _exact(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), 65536):
            s = slice(i, i + 65536)
            out[s] = np.einsum("ij,ij->i", q[rows[s]], self.vectors[cols[s]])
        return np.round(out, DECIMALS)

    def query(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, _TILE // len(self.names))
        for i in range(0, len(ids), step):
            yield from self._tile(ids[i : i + step], vectors[i : i + step].astype(np.float64))

    def _tile(self, names: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        base, c = self.codes, Codes(q, self.centre, self.turn)
        bits = self.turn.shape[1]
        far = np.zeros((len(q), len(self.names)), np.uint16)
        for w in range(c.words.shape[1]):
            far += np.bitwise_count(c.words[:, w, None] ^ base.words[None, :, w])
        scale = np.outer(c.length / c.fit, base.length / base.fit).astype(np.float32)
        estimate = scale * (1 - (2 / bits) * far.astype(np.float32))
        estimate += (c.along[:, None] + base.along[None, :] - self.square).astype(np.float32)
        error = np.sqrt((c.spread[:, None] + base.spread[None, :]).astype(np.float32) / (bits - 1))
        error *= np.outer(c.length, base.length).astype(np.float32) * np.float32(self.epsilon)
        upper = np.minimum(estimate + error, 1) + 1e-5
        maybe = upper >= self.least
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        own = np.flatnonzero(self.names[at] == names)
        maybe[own, at[own]] = False
        bar = np.full(len(q), self.least)
        many = np.flatnonzero(maybe.sum(1) > 16 * self.k)
        if len(many):
            few = 16 * self.k
            guess = np.where(maybe[many], estimate[many], np.float32(-9))
            best = np.argpartition(-guess, few, axis=1)[:, :few]
            rows = np.repeat(many, few)
            exact = self._exact(q, rows, best.ravel()).reshape(-1, few)
            bar[many] = np.maximum(self.least, np.partition(exact, few - self.k, axis=1)[:, few - self.k])
            maybe[many] &= upper[many] >= bar[many, None] - 2e-6
        if 32 * np.count_nonzero(maybe) > maybe.size:
            every = q @ self.vectors.T
            every[own, at[own]] = -9
            rows, cols = np.nonzero(every >= bar[:, None] - 10.0**-DECIMALS)
            similar = np.round(every[rows, cols], DECIMALS)
            keep = similar >= bar[rows]
            rows, cols, similar = rows[keep], cols[keep], similar[keep]
        else:
            rows, cols = np.nonzero(maybe)
            similar = self._exact(q, rows, cols)
            keep = similar >= bar[rows]
            rows, cols, similar = rows[keep], cols[keep], similar[keep]
        if not len(rows):
            return
        order = np.lexsort((cols, -similar, rows))  # columns are in order of id
        rows, cols, similar = rows[order], cols[order], similar[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        top = rank < self.k
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[rows[top]]), pa.array(self.names[cols[top]]), pa.array(similar[top])], names=["id", "other", "similarity"]
        )

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, margin: float | None = None, words: int = WORDS, epsilon: float = EPSILON,
            rows_per_cell: int | None = None, max_cells: int = MAX_CELLS, block_rows: int = BLOCK_ROWS, dimension: int = DIMENSION) -> DataFrame:
    """``(id, other, similarity, rank)``: for each row of ``(id, vector)`` its ``k`` most similar other rows, best first.

    Similarity is the cosine, rounded to 6 decimals; ties go to the smaller id. Only similarities of ``least`` or more are
    listed. The ids have to be unique and the vectors usable, see `vectors.current_vectors`. Equal vectors are searched
    once: of a group of equals the k + 1 smallest ids stand for all, as no list can hold more of them, so a vector that a third of
    all rows share costs nothing more, and every member still gets its own list. An empty table gives no rows. By default the cells
    within MARGIN are asked if ``least`` is PROBED_LEAST or more, else all, cut as large as a block.
    """
    probed = least >= PROBED_LEAST
    margin = margin if margin is not None else MARGIN if probed else np.inf
    rows_per_cell = rows_per_cell or (ROWS_PER_CELL if probed or margin < np.inf else block_rows)
    spark = vectors.sparkSession
    all_rows = marked(vectors, dimension, np.float64)
    heads = distinct_vectors(all_rows)
    distinct = heads.select(F.col("rid").alias("id"), "vec")
    n = heads.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, similarity double, rank int")
    cells = cell_count(n, rows_per_cell, max_cells)
    centroids = spherical_kmeans(fit_sample(distinct, max(FIT_SAMPLE, FIT_PER_CELL * cells), dimension), cells)
    celled = materialize(with_cells(distinct, centroids, margin, dimension), "cells")
    found = meet_in_blocks(celled, lambda ids, v: Searcher(ids, v, k, least, words, epsilon), "id bigint, other bigint, similarity double", block_rows, dimension)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    found = materialize(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "found")
    discard(celled)
    # members of groups of equals: the k + 1 smallest of each, as candidates, and all, as askers
    twins = heads.where("n > 1").select("m1", "m2", F.col("rid").alias("head"))
    members = all_rows.select("id", "m1", "m2").join(twins, ["m1", "m2"]).select("head", F.col("id").alias("member"))
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("member"))).where(F.col("r") <= k + 1).groupBy("head").agg(F.array_sort(F.collect_list("member")).alias("few"))
    named = heads.select(F.col("rid").alias("other"), "head").join(few.withColumnRenamed("head", "other"), "other", "left").select("other", F.coalesce("few", F.array("head")).alias("few"))
    listed = found.join(named, "other").select(F.col("id").alias("head"), "similarity", F.explode("few").alias("other"))
    own = few.select("head", F.lit(1.0).alias("similarity"), F.explode("few").alias("other")).where(F.lit(least <= 1.0))
    ranked = (
        listed.unionByName(own)
        .withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("similarity"), "other")))
        .where(F.col("r") <= k + 1)
        .groupBy("head").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("o")))).alias("best"))
    )
    askers = heads.where("n = 1").select(F.col("rid").alias("head"), F.col("head").alias("member")).unionByName(members)
    return (
        askers.join(ranked, "head")
        .select(F.col("member").alias("id"), F.posexplode(F.slice(F.filter("best", lambda x: x["o"] != F.col("member")), 1, k)))
        .select("id", F.col("col.o").alias("other"), (-F.col("col.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))
    )


def recall(vectors: DataFrame, found: DataFrame, k: int, least: float, queries: int = RECALL_QUERIES) -> DataFrame:
    """One row ``(queries, answers, recalled, recall)``: the part of the true answers that ``found`` has, by brute force.

    Measured for the ``queries`` vectors of lowest hash, against all rows; that number bounds what each task holds. Without true
    answers the recall is 1.
    """
    spark = vectors.sparkSession
    rows = packed(vectors, kind=np.float64)
    asked = rows.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(queries).toArrow()
    names = asked.column(0).to_pylist()
    out = spark.createDataFrame([(len(names),)], "queries bigint")
    if not names:
        return out.selectExpr("queries", "0L AS answers", "0L AS recalled", "1D AS recall")
    q = spark.sparkContext.broadcast((names, np.frombuffer(b"".join(asked.column(1).to_pylist()), np.float64).reshape(len(names), -1)))

    def run(batches):
        ids, v = q.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = np.round(v @ np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1).T, DECIMALS)
                bar = np.full((len(s), 1), least)
                if part.num_rows > k + 1:  # a vector itself may be among the k + 1 best
                    bar = np.maximum(least, np.partition(s, part.num_rows - k - 1, axis=1)[:, part.num_rows - k - 1, None])
                i, j = np.nonzero(s >= bar)
                other = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.string()), pa.array([other[x] for x in j], pa.string()), pa.array(s[i, j])], names=["id", "other", "similarity"])

    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    truth = rows.mapInArrow(run, "id string, other string, similarity double").where("id <> other").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    hit = truth.join(found.select("id", "other").distinct().withColumn("hit", F.lit(1)), ["id", "other"], "left")
    counted = hit.agg(F.count(F.lit(1)).alias("answers"), F.count("hit").alias("recalled"))
    return out.crossJoin(counted).select(  # one row each
        "queries", "answers", "recalled", F.when(F.col("answers") > 0, F.col("recalled") / F.col("answers")).otherwise(1.0).alias("recall"))


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.94, **how) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of similarity ``least`` or more where one is among the ``k`` best of the other."""
    found = nearest(vectors, k, least, **how)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
