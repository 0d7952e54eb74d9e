"""The queries of this folder's operators and, where SQL can express them, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, clusters, mixing, nearest, seen, stuffing
from .vectors import current_texts, current_vectors


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return current_vectors(table(spark, d, "vector_documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.similar_pairs(_vectors(spark, d), k=5, least=0.94)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest.nearest(_vectors(spark, d), k=5, least=0.94)


def p2_nearest_all(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar of every vector, however similar; `p2_nearest` lists those of 0.94 or more, as its SQL does."""
    return nearest.nearest(_vectors(spark, d), k=5)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """The loss of accuracy, measured against brute force: a row for the search without limit and one for that from 0.94 on."""
    vectors = _vectors(spark, d)
    measured = [nearest.recall(vectors, nearest.nearest(vectors, k=5, least=x), 5, x).withColumn("least", F.lit(x)) for x in (-1.0, 0.94)]
    return measured[0].unionByName(measured[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.repeats(spark, f"{d}/doc_records.parquet")


def p4_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rates(table(spark, d, "doc_records"), p4_found(spark, d), table(spark, d, "compact_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_vectors(spark, d))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    return clusters.describe(vectors, clusters.clusters(vectors))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Links of 0.82 or more of a stated set of vectors against all, by brute force, and how many of them lie within one cluster."""
    vectors = _vectors(spark, d)
    return clusters.link_recall(vectors, clusters.clusters(vectors))


def p5_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The current texts as hashed weighted features, divided by k-means: each cluster's size and members nearest its centroid."""
    texts = current_texts(table(spark, d, "vector_documents"))
    return clusters.text_clusters(texts)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_copies(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_nearest, p2_nearest_all, p2_recall, p4_found, p4_error_rates, p5_found, p5_clusters, p5_recall, p5_text_clusters, p6_ids, p7_copies, p7_shares, p8_found)
}

_USABLE = """
WITH RECURSIVE latest AS (
  SELECT id, vector, row_number() OVER (PARTITION BY id ORDER BY ver DESC NULLS LAST, vector DESC NULLS LAST) AS rn FROM vector_documents WHERE id IS NOT NULL
),
usable AS (
  SELECT id, vector FROM latest WHERE rn = 1 AND len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0
),
sims AS (
  SELECT a.id AS id, b.id AS other, round(list_cosine_similarity(a.vector, b.vector), 6) AS s FROM usable a JOIN usable b ON a.id <> b.id
)
"""

_MEMBERS = (
    _USABLE
    + """, links AS (SELECT id, other FROM sims WHERE s >= 0.82),
reach(id, other) AS (SELECT id, other FROM links UNION SELECT r.id, l.other FROM reach r JOIN links l ON r.other = l.id),
members AS (SELECT min(other) AS first_id, id FROM (SELECT id, other FROM reach UNION SELECT id, id FROM links) GROUP BY id)
"""
)

SQL: dict[str, str] = {
    "p2_found": _USABLE
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM sims WHERE s >= 0.94)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE r <= 5
""",
    "p2_nearest": _USABLE
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS r FROM sims WHERE s >= 0.94)
SELECT id, other, s AS similarity, CAST(r AS INTEGER) AS rank FROM ranked WHERE r <= 5
""",
    "p4_found": """
SELECT rec_no FROM (SELECT rec_no, min(rec_no) OVER (PARTITION BY collection, id) AS first FROM doc_records WHERE rec_no IS NOT NULL) WHERE rec_no > first
""",
    "p4_error_rates": """
WITH said AS (SELECT collection, rec_no > min(rec_no) OVER (PARTITION BY collection, id) AS again FROM doc_records WHERE rec_no IS NOT NULL),
built AS (SELECT collection, bloom_filter_built, row_number() OVER (PARTITION BY collection ORDER BY started_at DESC, run_no DESC) AS r FROM compact_results WHERE bloom_filter_built IS NOT NULL),
counted AS (SELECT collection, count(*) AS rows, count(*) FILTER (again) AS repeats FROM said GROUP BY collection)
SELECT c.collection, c.rows, c.repeats, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS wrong_rate, coalesce(b.bloom_filter_built, false) AS bloom_filter_built
FROM counted c LEFT JOIN built b ON b.collection IS NOT DISTINCT FROM c.collection AND b.r = 1
""",
    "p5_found": _MEMBERS + "SELECT first_id, id FROM members",
    "p5_clusters": _MEMBERS
    + """, elements AS (
  SELECT m.first_id, m.id, unnest(list_transform(u.vector, lambda x: x / sqrt(list_inner_product(u.vector, u.vector)))) AS x, unnest(range(64)) AS i FROM members m JOIN usable u ON u.id = m.id
),
sums AS (SELECT first_id, i, sum(x) AS s, count(*) AS size FROM elements GROUP BY first_id, i),
near AS (SELECT e.first_id, e.id, max(s.size) AS size, round(sum(e.x * s.s) / max(s.size), 6) AS near FROM elements e JOIN sums s ON s.first_id = e.first_id AND s.i = e.i GROUP BY e.first_id, e.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first_id ORDER BY near DESC, id) AS r FROM near)
SELECT first_id, max(size) AS size, list(id ORDER BY r) FILTER (WHERE r <= 3) AS typical FROM ranked GROUP BY first_id
""",
}
