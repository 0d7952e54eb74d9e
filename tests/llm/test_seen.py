import random

import pytest

from logstrata.llm import seen

SCHEMA = "rec_no bigint, collection string, id string, key string, bucket int"
RUNS = "run_no bigint, collection string, started_at timestamp, bloom_filter_built boolean"


def brute(rows):
    first = {}
    for n, c, i in rows:
        if n is not None:
            first[c, i] = min(first.get((c, i), n), n)
    return sorted(n for n, c, i in rows if n is not None and n > first[c, i])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 10), (3, 0)])
def test_records_out_of_order_over_several_runs(spark, tmp_path, monkeypatch, seed, hot):
    monkeypatch.setattr(seen, "HOT", hot)
    r = random.Random(seed)
    keys = [("a", "hot")] * 30 + [(c, f"k{i}") for c in "ab" for i in range(40)] + [(None, "k1"), ("a", None), (None, None), ("", ""), ("a", "=k1"), ("a|=k", "1")]
    rows = [(n, *r.choice(keys)) for n in range(600)]
    r.shuffle(rows)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in range(3):  # a later run goes on from the state of the earlier ones
        frame(spark, rows[part * 200 : part * 200 + 200]).repartition(2).write.mode("append").parquet(src)
        got = seen.repeats(spark, src, out, cp, max_bytes_per_trigger=1)
        assert sorted(x.rec_no for x in got.collect()) == brute(rows[: part * 200 + 200])


def test_a_batch_writes_the_state_of_its_own_keys(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    frame(spark, [(n, "a", f"k{n}") for n in range(2000)]).write.mode("append").parquet(src)
    seen.remember(spark, src, out, cp)
    frame(spark, [(2000 + n, "a", f"k{n % 5}") for n in range(20)]).write.mode("append").parquet(src)
    state = seen.remember(spark, src, out, cp)[-1]["stateOperators"][0]
    assert state["numRowsUpdated"] == 5 and state["numRowsTotal"] == 2000
    assert sorted(r.rec_no for r in seen.repeats(spark, src, out, cp).collect()) == list(range(2000, 2020))
    # a file that is gone is remembered
    late = str(tmp_path / "late")
    frame(spark, [(5000, "a", "k7"), (5001, "a", "new")]).write.parquet(late)
    assert [r.rec_no for r in seen.later_than_first(seen.prints(spark.read.parquet(late)), seen.firsts_of(spark, out)).collect()] == [5000]


def test_repeated_rows_nulls_and_an_empty_table(spark, tmp_path):
    rows = [(5, "a", "x"), (5, "a", "x"), (7, "a", "x"), (7, "a", "x"), (None, "a", "x"), (9, "b", "x"), (3, "b", "x")]
    frame(spark, rows).write.parquet(str(tmp_path / "r"))
    got = seen.repeats(spark, str(tmp_path / "r"))
    assert sorted(x.rec_no for x in got.collect()) == [7, 7, 9]
    frame(spark, []).write.parquet(str(tmp_path / "e"))
    assert seen.repeats(spark, str(tmp_path / "e")).count() == 0


def test_rates_count_wrong_answers(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x"), (5, None, "x")]
    runs = spark.createDataFrame([(1, "a", None, True), (2, "a", None, None), (3, "zz", None, True)], RUNS)
    found = spark.createDataFrame([(2,), (3,)], "rec_no bigint")
    got = {r.collection: tuple(r)[1:] for r in seen.error_rates(frame(spark, rows), found, runs).collect()}
    assert got == {"a": (3, 2, 1, 1 / 3, True), None: (2, 0, 1, 0.5, False)}
