import random

import pytest
from pyspark.sql import functions as F

from logstrata.operators import maintenance, query, state

SCHEMA = "id string, deleted boolean, ts bigint, ord bigint, v int"


def replay(log, at=None):
    """Storage order by hand: last version per id, ids in order of first appearance."""
    last = {}
    for id_, deleted, ts, _, v in sorted(log, key=lambda r: r[3]):
        if at is None or ts is None or ts <= at:
            last[id_] = None if deleted else v
    return [(k, v) for k, v in last.items() if v is not None]


def random_log(seed, n=300):
    r = random.Random(seed)
    return [(f"d{r.randint(0, 40)}", (x := r.random() < 0.2), r.choice([None, r.randint(0, 1000)]), i, None if x else i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_replay_at_every_time(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, SCHEMA).repartition(3)
    for at in (None, 0, 500, 999):
        want = replay(log, at)
        assert sorted(want) == sorted((r.id, r.v) for r in state.current_state(df, at).collect())
        assert want == [(r.id, r.v) for r in state.with_first_seen(df, at).orderBy("first_seen").collect()]
        assert state.count_live(df, at).first().n == len(want)
    got = {r.as_of_ms: r.n for r in state.count_timeline(df, [0, 500, 999]).collect()}
    assert got == {t: len(replay(log, t)) for t in (0, 500, 999)}
    assert maintenance.vacuumed(df).count() == len(replay(log))
    s = maintenance.vacuum_stats(df).first()
    assert (s.scanned, s.kept, s.removed) == (len(log), len(replay(log)), len(log) - len(replay(log)))


def test_pages_follow_first_appearance(spark):
    log = random_log(3)
    df = spark.createDataFrame(log, SCHEMA)
    want = replay(log)
    assert [(r.id, r.v) for r in query.find(df, limit=5, offset=3).collect()] == want[3:8]
    assert query.find(df, limit=0).count() == 0
    for bad in (-1, 1.5, float("nan"), True):
        with pytest.raises(ValueError):
            query.find(df, limit=bad)
    page, more = query.list_request(df, {"limit": "7", "offset": "2"})
    assert [r.id for r in page.collect()] == [k for k, _ in want[2:9]]
    assert tuple(more.first()) == (7, 2, len(want) > 9)
    assert query.list_request(df, {"limit": "1000"})[1].first().page_limit == 100
    assert query.list_request(df, {"limit": "x", "offset": "-4"})[1].first()[:2] == (20, 0)


def test_expiry_is_strict_and_ignores_null(spark):
    df = spark.createDataFrame([("a", False, 1, 1, 99), ("b", False, 1, 2, 100), ("c", False, 1, 3, None)], SCHEMA)
    assert {r.id for r in state.current_state(df, now=100, ttl="v").collect()} == {"b", "c"}
    assert [r.id for r in state.expired(df, 100, "v").collect()] == ["a"]
    dead = state.expiry_tombstones(df, 100, "v", F.lit(9))
    assert dead.dtypes == df.dtypes
    assert {r.id for r in state.current_state(df.unionByName(dead)).collect()} == {"b", "c"}


def test_get_many_takes_lists_and_frames(spark, rows):
    df = spark.createDataFrame([("a", False, 1, 1, 1), ("a", False, 2, 2, 2), ("b", True, 1, 3, None), ("c", False, 1, 4, 4)], SCHEMA)
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",), (None,)], "k string")
    assert rows(query.get_many(df, ids).select("id", "v")) == [("a", 2)]
    assert rows(query.get_many(df, ["a", "a", "b", "zz"]).select("id", "v")) == [("a", 2)]
    assert rows(query.get(df, "a", at=1).select("v")) == [(1,)]
    assert query.get(df, "b").count() == 0


def test_empty_nulls_repeats_and_clashing_names(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert state.current_state(empty).count() == 0 and state.count_live(empty).first().n == 0
    assert maintenance.vacuum_stats(empty).first().scanned == 0
    assert state.count_timeline(empty, [5]).first().n == 0
    df = spark.createDataFrame([(None, False, 1, 1, 1), ("a", False, None, None, 2), ("a", False, 1, 1, 3), ("a", False, 1, 1, 3)], SCHEMA).withColumn("first_seen", F.lit("x")).withColumn("score", F.lit(1))
    assert rows(state.current_state(df).select("id", "v")) == [("a", 3)]
    assert rows(state.with_first_seen(df).select("id", "v", "first_seen")) == [("a", 3, 1)]


def test_plan_filters_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame(random_log(4), SCHEMA).write.parquet(str(tmp_path / "log"))
    plan = query.get(spark.read.parquet(str(tmp_path / "log")), "d1", at=500)._jdf.queryExecution().toString()
    assert "EqualTo(id,d1)" in plan and "WindowGroupLimit" in plan


def test_lease_and_policy():
    assert maintenance.lease_ms(0, 0) == 30_000
    assert maintenance.lease_ms(1_000_000, 10) == 32_030
    assert maintenance.lease_ms(0, 10, vacuum=True) == 64_000
    assert maintenance.lease_ms(10**12, 0) == maintenance.lease_ms(10**12, 0, True) == 600_000
    rng = random.Random(1)
    assert maintenance.ALWAYS.compacts(0, rng) and not maintenance.NEVER.compacts(9, rng)
    assert not maintenance.Policy(1.0, 5).compacts(4, rng) and maintenance.Policy(1.0, 5).compacts(5, rng)
