"""Similarity clusters of vectors, or of texts turned into vectors.

1. Texts become vectors by hashed features weighted by their rarity (`hashed_features`); vectors are taken as they are.
2. Distributed k-means on the unit vectors: the seeds are drawn over several rounds, each oversampling all rows by their squared
   distance to the seeds so far (k-means||), weighted by the rows nearest to them and reduced to k; then a few rounds of moving
   the centroids. A round is one pass that sends k partial sums per task.
3. The cells of k-means, with the neighbours of each border, are where mutually similar vectors meet; there all pairs are
   compared exactly, in blocks, and each block only reports who belongs to whom, a number of links linear in its vectors.
4. Links are joined into clusters by the smallest id, and each cluster is described by its size and the members nearest its own
   centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize
from .vectors import BLOCK_ROWS, DIMENSION, MAX_CELLS, cell_count, distinct_vectors, from_binary, marked, meet_in_blocks, packed, with_cells

#: Least similarity of two members that are linked; decimals it is rounded to.
LEAST, DECIMALS = 0.82, 6
#: Width of the band around a cell's border in which vectors meet the neighbours too: two vectors of LEAST are 0.6 apart, and a pair
#: is missed if its part along the border's normal, about 0.6 / 8 at 64 dimensions, exceeds twice the width: four times as much.
MARGIN = 0.15
#: A word is hot if it makes up one of so many parts of all words of all texts; as many can be hot at most.
HOT_WORDS = 1000
#: Vectors aimed at for a cell; more of them make fewer cells, of which each vector probes fewer, for a larger product per cell.
ROWS_PER_CELL = 2048
#: Rounds of seeding, seeds drawn per round as a part of k, and rounds of moving the centroids.
SEED_ROUNDS, OVERSAMPLING, MOVES = 4, 0.5, 4


def hashed_features(texts: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """``(id, vector array<double>)`` from ``(id, text)``: signed hashed words weighted by tf * log(1 + rows / rows with the word).

    Words are runs of letters and digits, lower-cased. The weights come from all rows; words are counted per row before the
    shuffle. Words that make up a thousandth of all or more, so a thousand at most, are broadcast with their counts, so that a word of
    every text isn't joined in one task. Rows whose text is null or holds no word get a zero vector, which no operator here uses.
    """
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    rarity = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words")
    total = rarity.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    often = F.col("df") * HOT_WORDS >= total
    met = words.join(F.broadcast(rarity.where(often)), "word", "left")  # HOT_WORDS rows at most
    weighted = met.where("df IS NOT NULL").unionByName(met.where("df IS NULL").drop("df").join(rarity.where(~often), "word"))
    rows = texts.agg(F.count(F.lit(1)).alias("rows"))
    slot, sign = F.pmod(F.xxhash64("word"), F.lit(dimension)), F.when(F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = (
        weighted.crossJoin(F.broadcast(rows))  # one row
        .groupBy("id", slot.alias("slot")).agg(F.sum(sign * F.col("tf") * F.log1p(F.col("rows") / F.col("df"))).alias("x"))
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    )
    filled = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dimension - 1).cast("bigint")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return texts.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce(filled, F.array_repeat(F.lit(0.0), dimension)).alias("vector"))


def _nearest(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = u @ c.T
    best = s.argmax(1)
    return best, s[np.arange(len(u)), best]


def _chunks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            yield part, from_binary(part.column(part.num_columns - 1), dimension)


def seed_centroids(vectors: DataFrame, k: int, seed: int = 23, rounds: int = SEED_ROUNDS, oversampling: float = OVERSAMPLING, dimension: int = DIMENSION) -> np.ndarray:
    """k seeds of ``(id, vec)`` by parallel oversampling; about 1 + rounds * oversampling * k candidates come to the driver."""
    sc = vectors.sparkSession.sparkContext
    first = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("vec").toArrow()
    candidates = from_binary(first.column(0).combine_chunks(), dimension)
    for r in range(rounds):
        shipped = sc.broadcast(candidates)

        def cost(batches, shipped=shipped):
            total = 0.0
            for _, u in _chunks(batches, dimension):
                total += float(np.maximum(2 - 2 * _nearest(u, shipped.value)[1], 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["cost"])

        whole = vectors.select("vec").mapInArrow(cost, "cost double").agg(F.sum("cost")).first()[0] or 0.0
        if whole <= 1e-9:
            break

        def draw(batches, shipped=shipped, whole=whole, r=r):
            import xxhash

            for part, u in _chunks(batches, dimension):
                chance = np.maximum(2 - 2 * _nearest(u, shipped.value)[1], 0) * (oversampling * k / whole)
                luck = np.array([xxhash.xxh3_64_intdigest(str(i), seed=seed + r) for i in part.column(0).to_pylist()]) / 2.0**64
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(luck < chance))], names=["vec"])

        drawn = vectors.select("id", "vec").mapInArrow(draw, "vec binary").toArrow()
        if drawn.num_rows:
            candidates = np.concatenate([candidates, from_binary(drawn.column(0).combine_chunks(), dimension)])
    if len(candidates) <= k:
        return candidates
    shipped = sc.broadcast(candidates)

    def weigh(batches):
        n = np.zeros(len(shipped.value), np.int64)
        for _, u in _chunks(batches, dimension):
            n += np.bincount(_nearest(u, shipped.value)[0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["c", "n"])

    weight = np.zeros(len(candidates))
    for c, n in vectors.select("vec").mapInArrow(weigh, "c bigint, n bigint").groupBy("c").agg(F.sum("n")).collect():
        weight[c] = n
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    gap = np.maximum(2 - 2 * candidates @ candidates[chosen[0]], 0)
    for _ in range(k - 1):
        p = gap * weight
        total = p.sum()
        if total <= 1e-12:
            break
        chosen.append(int(rng.choice(len(p), p=p / total)))
        gap = np.minimum(gap, np.maximum(2 - 2 * candidates @ candidates[chosen[-1]], 0))
    return candidates[chosen]


def move_centroids(vectors: DataFrame, centroids: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """One round of k-means over all rows of ``(id, vec)``. A centroid that nothing is nearest to stays."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches):
        c = shipped.value
        out = np.zeros((len(c), dimension))
        for _, u in _chunks(batches, dimension):
            who = _nearest(u, c)[0]
            order = np.argsort(who, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(who[order]) != 0])
            out[who[order][starts]] += np.add.reduceat(u[order].astype(np.float64), starts, axis=0)
        used = np.flatnonzero(np.abs(out).sum(1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(out[used]), pa.list_(pa.float64()))], names=["c", "s"])

    parts = vectors.select("vec").mapInArrow(sums, "c bigint, s array<double>").groupBy("c").agg(*[F.sum(F.col("s")[i]).alias(f"x{i}") for i in range(dimension)])
    moved = centroids.copy()
    for row in parts.collect():  # one row per centroid
        x = np.array(row[1:])
        norm = np.linalg.norm(x)
        if norm > 1e-9:
            moved[row[0]] = x / norm
    return moved


def kmeans(vectors: DataFrame, k: int, moves: int = MOVES, dimension: int = DIMENSION) -> np.ndarray:
    """k unit centroids of all rows of ``(id, vec)``; fewer if there are fewer distinct vectors."""
    c = seed_centroids(vectors, k, dimension=dimension)
    for _ in range(moves):
        c = move_centroids(vectors, c, dimension)
    return c


class Linker:
    """One block of one cell: who of the block and of the vectors that meet it belong together."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, least: float):
        self.ids, self.vectors, self.least = ids, vectors, least
        self.root = np.arange(len(vectors))

    def query(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // len(self.vectors))
        for at in range(0, len(vectors), step):
            asked = vectors[at : at + step]
            row, col = np.nonzero(asked @ self.vectors.T >= self.least - 2e-6)
            if not len(row):
                continue
            keep = np.empty(len(row), bool)
            for i in range(0, len(row), 65536):
                r, c = row[i : i + 65536], col[i : i + 65536]
                exact = np.einsum("ij,ij->i", asked[r].astype(np.float64), self.vectors[c].astype(np.float64))
                keep[i : i + 65536] = np.round(exact, DECIMALS) >= self.least
            row, col = row[keep], col[keep]
            if not len(row):
                continue
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            labels = self.root[col]
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            ends = np.r_[starts[1:], len(row)]
            for i in np.flatnonzero(low != high):
                mine = np.unique(self.root[col[starts[i] : ends[i]]])
                if len(mine) > 1:
                    self.root[np.isin(self.root, mine[1:])] = mine[0]
            who, met = ids[at + row[starts]], self.ids[col[starts]]
            other = who != met
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(who[other]), pa.array(met[other])], names=["a", "b"])

    def close(self) -> Iterator[pa.RecordBatch]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[moved]), pa.array(self.ids[self.root[moved]])], names=["a", "b"])


def components(links: DataFrame, steps: int = 60) -> DataFrame:
    """``(id, first_id)`` for every id of ``(a, b)``, first_id being the smallest id that it is linked with, directly or not.

    Each step gives every id the smallest label among its neighbours and itself, and then that label's own label. Written to the
    shared folder each time, in the place of the step before. The minima of a hub are combined on the map side; a hub's links are
    split by the adaptive planner.
    """
    # written first: which links a block reports depends on the order of its rows, so both directions have to come from one run
    once = materialize(links.where("a <> b").select("a", "b"), "links")
    both = materialize(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    discard(once)
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    for _ in range(steps):
        now = labels.select("id", "label")
        heard = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        told = now.join(heard, "id").select("id", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        jump = now.select(F.col("id").alias("near"), F.col("label").alias("far"))
        joined = told.join(jump, "near").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("was")).alias("moved"))
        before, labels = labels, materialize(joined, "labels")
        discard(before)
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("id", F.col("label").alias("first_id"))
    raise RuntimeError("the links did not settle")


def clusters(vectors: DataFrame, least: float = LEAST, margin: float = MARGIN, rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS,
             block_rows: int = BLOCK_ROWS, dimension: int = DIMENSION) -> DataFrame:
    """``(first_id, id)``: one row for each member of a cluster of two or more rows of ``(id, vector)``.

    Two vectors belong together if their cosine, rounded to 6 decimals, is ``least`` or more, or if others link them. first_id
    is the smallest id of the cluster. The ids have to be unique and the vectors usable, see `vectors.current_vectors`; equal
    vectors under several ids are compared once and stay members each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = marked(vectors, dimension)
    heads = distinct_vectors(rows)
    n = heads.count()
    if n == 0:
        return spark.createDataFrame([], "first_id string, id string")
    distinct = heads.select(F.col("rid").alias("id"), "vec")
    centroids = kmeans(distinct, cell_count(n, rows_per_cell, max_cells), dimension=dimension)
    celled = materialize(with_cells(distinct, centroids, margin, dimension), "cells")
    labels = components(meet_in_blocks(celled, lambda ids, v: Linker(ids, v, least), "a bigint, b bigint", block_rows, dimension))
    discard(celled)
    # of the vectors that are linked or that several ids have, the smallest vector of the cluster, and its smallest id
    grouped = heads.select("rid", "n", "m1", "m2").join(labels.select(F.col("id").alias("rid"), "first_id"), "rid", "left").where("first_id IS NOT NULL OR n > 1")
    grouped = grouped.select("m1", "m2", F.coalesce("first_id", "rid").alias("rid")).join(heads.select("rid", F.col("head").alias("first_id")), "rid")
    return rows.select("id", "m1", "m2").join(grouped, ["m1", "m2"]).select("first_id", "id")


def assigned(vectors: DataFrame, centroids: np.ndarray, dimension: int = DIMENSION) -> DataFrame:
    """``(id, cluster int, near double)`` of `packed` vectors: the nearest centroid and the similarity to it, to 6 decimals."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CELLS rows

    def run(batches):
        for part, u in _chunks(batches, dimension):
            best, near = _nearest(u, shipped.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(np.round(near.astype(np.float64), DECIMALS))], names=["id", "cluster", "near"])

    return vectors.select("id", "vec").mapInArrow(run, "id string, cluster int, near double")


def text_clusters(texts: DataFrame, rows_per_cluster: int = 64, most: int = 1024, typical: int = 3, dimension: int = DIMENSION) -> DataFrame:
    """``(cluster int, size bigint, typical array<string>)`` of ``(id, text)``: hashed weighted features divided by k-means into one
    cluster for each ``rows_per_cluster`` texts, at most ``most``; the typical ids are those nearest the centroid, the nearest first, ties
    by id. Texts that are null or hold no word belong to no cluster; no cluster is empty, and an empty table has none.
    """
    spark = texts.sparkSession
    usable = hashed_features(texts, dimension).where(F.exists("vector", lambda x: x != 0))
    features = materialize(packed(usable, dimension), "features")
    n = features.count()
    if n == 0:
        return spark.createDataFrame([], "cluster int, size bigint, typical array<string>")
    placed = assigned(features, kmeans(features, cell_count(n, rows_per_cluster, most), dimension=dimension), dimension)
    near = F.struct((-F.col("near")).alias("far"), "id")
    # the nearest few of each cluster by a group limit before the shuffle; sizes by a count combined before it
    first = placed.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("near"), "id"))).where(F.col("r") <= typical)
    first = first.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(near)), lambda x: x["id"]).alias("typical"))
    return placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(first, "cluster")


def link_recall(vectors: DataFrame, members: DataFrame, least: float = LEAST, queries: int = 1000, dimension: int = DIMENSION) -> DataFrame:
    """One row ``(queries, links, kept, recall)``: of the links of ``queries`` vectors with all rows, by brute force in double
    precision, the part whose ends lie in one cluster of ``members``. The vectors are those of the lowest hash; their number bounds
    what each task holds. Without links the recall is 1."""
    spark = vectors.sparkSession
    rows = packed(vectors, dimension, np.float64)
    asked = rows.orderBy(F.xxhash64("id", F.lit(31)), "id").limit(queries).toArrow()
    names = asked.column(0).to_pylist()
    out = spark.createDataFrame([(len(names),)], "queries bigint")
    if not names:
        return out.selectExpr("queries", "0L AS links", "0L AS kept", "1D AS recall")
    q = spark.sparkContext.broadcast((names, np.frombuffer(b"".join(asked.column(1).to_pylist()), np.float64).reshape(len(names), -1)))

    def run(batches):
        ids, v = q.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                i, j = np.nonzero(np.round(v @ np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1).T, DECIMALS) >= least)
                other = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.string()), pa.array([other[x] for x in j], pa.string())], names=["a", "b"])

    links = rows.mapInArrow(run, "a string, b string").where("a <> b")
    first = members.select(F.col("id").alias("a"), F.col("first_id").alias("fa")), members.select(F.col("id").alias("b"), F.col("first_id").alias("fb"))
    met = links.join(first[0], "a", "left").join(first[1], "b", "left").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("fa") == F.col("fb")).alias("kept"))
    return out.crossJoin(met).select("queries", "links", "kept", F.when(F.col("links") > 0, F.col("kept") / F.col("links")).otherwise(1.0).alias("recall"))  # one row each


def describe(vectors: DataFrame, members: DataFrame, typical: int = 3, dimension: int = DIMENSION) -> DataFrame:
    """``(first_id, size, typical array<string>)``: each cluster's size and the ids nearest its centroid, the nearest first.

    Ties go to the smaller id. Centroids are means of unit vectors; sums are combined on the map side.
    """
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.select("id", F.transform("vector", lambda x: x / norm).alias("v"))
    joined = members.join(unit, "id")
    means = joined.groupBy("first_id").agg(F.count(F.lit(1)).alias("size"), F.array(*[F.sum(F.col("v")[i]) for i in range(dimension)]).alias("c"))
    near = F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ranked = joined.join(means, "first_id").select("first_id", "size", "id", F.round(near / F.col("size"), DECIMALS).alias("near"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("first_id").orderBy(F.desc("near"), "id"))).where(F.col("r") <= typical)
    return ranked.groupBy("first_id").agg(F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
