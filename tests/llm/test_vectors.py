import math
import random

import numpy as np
import pytest

from logstrata.llm import clusters, nearest, vectors

SCHEMA = "id string, ver int, vector array<double>, score int, head string"


def grouped(seed, groups=12, dim=64):
    """Groups of similar vectors, equal vectors under several ids, and vectors like nothing else."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = r.standard_normal(dim)
        for i in range(int(r.integers(2, 14))):
            v = centre + r.standard_normal(dim) * 0.15
            out.append(v * float(r.choice([0.01, 1, 50])))
            if r.random() < 0.2:
                out += [out[-1].copy() for _ in range(int(r.integers(1, 9)))]
    out += [r.standard_normal(dim) for _ in range(60)]
    ids = [f"d{i}" for i in r.permutation(len(out))]
    return [(i, v.tolist()) for i, v in zip(ids, out)]


def similarities(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.round(x @ x.T, 6)


def brute_nearest(rows, k, least):
    s = similarities(rows)
    out = set()
    for i, (a, _) in enumerate(rows):
        best = sorted(((-s[i, j], b) for j, (b, _) in enumerate(rows) if j != i and s[i, j] >= least))[:k]
        out |= {(a, b, n + 1) for n, (_, b) in enumerate(best)}
    return out


@pytest.mark.parametrize("least, margin", [(0.94, 0.08), (0.3, 0.5)])
def test_nearest_equals_brute_force(spark, least, margin):
    rows = grouped(1)
    df = spark.createDataFrame([(i, 1, v, 1, "x") for i, v in rows], SCHEMA)
    got = nearest.nearest(vectors.current_vectors(df), 5, least, margin=margin, rows_per_cell=20, block_rows=16)
    want = brute_nearest(rows, 5, least)
    found = {(r.id, r.other, r["rank"]) for r in got.collect()}
    assert len(found & want) >= 0.98 * len(want) and len(found) <= len(want)
    assert nearest.recall(vectors.current_vectors(df), got, 5, least, 50).first().recall >= 0.95


def test_many_equal_vectors_are_listed_by_the_smallest_ids(spark):
    rows = [(f"e{i:03d}", [1.0] + [0.0] * 63) for i in range(100)] + [("zz", [0.0, 1.0] + [0.0] * 62)]
    df = spark.createDataFrame([(i, 1, v, 1, "x") for i, v in rows], SCHEMA)
    got = {(r.id, r.other) for r in nearest.nearest(vectors.current_vectors(df), 5, 0.94).collect()}
    assert got == {(a, b) for a, b, _ in brute_nearest(rows, 5, 0.94)}
    assert clusters.clusters(vectors.current_vectors(df)).count() == 100


def test_only_the_current_usable_version_takes_part(spark):
    one = [1.0] + [0.0] * 63
    bad = [None, [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [math.inf] + [1.0] * 63, [0.0] * 64]
    rows = [("a", 1, one), ("a", 1, one), ("b", 2, one), ("b", 1, [0.0, 1.0] + [0.0] * 62), ("n", None, one), (None, 1, one), ("huge", 1, [1e308] * 64)]
    rows += [(f"bad{i}", 2, v) for i, v in enumerate(bad)] + [(f"bad{i}", 1, one) for i in range(len(bad))]
    df = spark.createDataFrame([(i, v, x, 1, "y") for i, v, x in rows], SCHEMA)
    assert sorted(r.id for r in vectors.current_vectors(df).collect()) == ["a", "b", "huge", "n"]
    got = sorted((r.id_a, r.id_b) for r in nearest.similar_pairs(vectors.current_vectors(df)).collect())
    assert got == [("a", "b"), ("a", "n"), ("b", "n")]


def test_empty_tables(spark):
    none = vectors.current_vectors(spark.createDataFrame([], SCHEMA))
    assert nearest.nearest(none).count() == 0 and nearest.similar_pairs(none).count() == 0 and clusters.clusters(none).count() == 0
    assert nearest.recall(none, nearest.nearest(none), 5, 0.9).first().recall == 1.0
    lone = vectors.current_vectors(spark.createDataFrame([("a", 1, [1.0] * 64, 1, "x")], SCHEMA))
    assert nearest.nearest(lone).count() == 0 and clusters.clusters(lone).count() == 0


def test_clusters_equal_components_of_brute_force(spark, rows):
    data = grouped(2)
    df = vectors.current_vectors(spark.createDataFrame([(i, 1, v, 1, "x") for i, v in data], SCHEMA))
    s = similarities(data) >= 0.82
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(s)):
        root[find(i)] = find(j)
    groups = {}
    for i, (name, _) in enumerate(data):
        groups.setdefault(find(i), []).append(name)
    want = sorted((min(g), m) for g in groups.values() if len(g) > 1 for m in g)
    members = clusters.clusters(df, margin=0.2, rows_per_cell=30, block_rows=16)
    assert sorted(tuple(r) for r in members.collect()) == want
    described = {r.first_id: (r["size"], r.typical) for r in clusters.describe(df, members).collect()}
    by = dict(data)
    for g in groups.values():
        if len(g) > 1:
            x = np.array([by[m] for m in g])
            x /= np.linalg.norm(x, axis=1)[:, None]
            near = np.round(x @ x.mean(0), 6)
            assert described[min(g)] == (len(g), [m for _, m in sorted(zip(-near, g))[:3]])


def test_chains_of_links(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(f"{order[i]:03d}", f"{order[i + 1]:03d}") for i in range(n - 1)] + [("x", "y"), ("y", "x"), ("q", "q")], "a string, b string")
    got = {r.id: r.first_id for r in clusters.components(links).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(n)}, "x": "x", "y": "x"}


def test_kmeans_finds_separate_groups(spark):
    r = np.random.default_rng(3)
    centres = np.linalg.qr(r.standard_normal((64, 64)))[0][:6]
    data = [(f"{g}-{i}", 1, (centres[g] + r.standard_normal(64) * 0.02).tolist(), 1, "x") for g in range(6) for i in range(30)]
    packed = vectors.packed(vectors.current_vectors(spark.createDataFrame(data, SCHEMA))).persist()
    c = clusters.kmeans(packed, 6)
    assert len(c) == 6 and ((c @ centres.T).max(0) > 0.99).all()
    packed.unpersist()


def test_hashed_features_of_texts(spark):
    texts = [("a", "red apple pie recipe"), ("b", "Recipe: RED apple pie!"), ("c", "quarterly tax report"), ("n", None), ("e", "")]
    got = {r.id: r.vector for r in clusters.hashed_features(spark.createDataFrame(texts, "id string, text string"), 64).collect()}
    assert set(got) == {"a", "b", "c", "n", "e"} and got["n"] == got["e"] == [0.0] * 64
    assert got["a"] == pytest.approx(got["b"]) and got["a"] != got["c"] and any(got["a"])
    members = clusters.clusters(vectors.current_vectors(spark.createDataFrame([(i, 1, v, 1, "x") for i, v in got.items()], SCHEMA)))
    assert sorted(tuple(r) for r in members.collect()) == [("a", "a"), ("a", "b")]


def test_texts_divided_by_kmeans(spark):
    words = "red apple pie,tax report form,tram bell line".split(",")
    texts = [(f"{g}{i:02d}", f"{words[g]} {words[g]} note {i}") for g in range(3) for i in range(20)] + [("n", None), ("e", ""), ("f", "!?")]
    df = spark.createDataFrame(texts, "id string, text string")
    got = clusters.text_clusters(df, rows_per_cluster=20).collect()
    assert sorted(r["size"] for r in got) == [20, 20, 20] and all(len(r.typical) == 3 and len({t[0] for t in r.typical}) == 1 for r in got)
    assert clusters.text_clusters(df.limit(0)).count() == 0 and clusters.text_clusters(df.where("id = 'n'")).count() == 0
    versions = spark.createDataFrame([("a", 1, "old"), ("a", 2, None), ("b", 1, "x"), ("b", 1, "x"), (None, 1, "y")], "id string, ver int, text string")
    assert sorted(map(tuple, vectors.current_texts(versions).collect())) == [("a", None), ("b", "x")]


def test_recall_of_links(spark):
    df = vectors.current_vectors(spark.createDataFrame([(i, 1, v, 1, "x") for i, v in grouped(5)], SCHEMA))
    found = clusters.clusters(df, margin=0.3, rows_per_cell=30)
    whole, none = clusters.link_recall(df, found).first(), clusters.link_recall(df, found.limit(0)).first()
    assert whole.links == whole.kept > 0 and whole.recall == 1.0 and none.links == whole.links and none.recall == 0.0
    assert clusters.link_recall(df.limit(0), found).first().recall == 1.0


def test_every_vector_gets_its_nearest_without_a_limit(spark):
    r = np.random.default_rng(4)
    rows = grouped(4) + [(f"q{i}", r.standard_normal(64).tolist()) for i in range(1100)]
    df = vectors.current_vectors(spark.createDataFrame([(i, 1, v, 1, "x") for i, v in rows], SCHEMA))
    want = brute_nearest(rows, 5, -1.0)
    for blocks in (16_384, 200):
        got = {(x.id, x.other, x["rank"]) for x in nearest.nearest(df, 5, block_rows=blocks).collect()}
        assert len(got) == len(want) == 5 * len(rows) and len(got & want) >= 0.99 * len(want)
    assert nearest.recall(df, nearest.nearest(df, 5), 5, -1.0, 100).first().recall >= 0.99
