import json
import random

import pytest

from logstrata.operators import compaction
from logstrata.runtime import Hdfs
from logstrata.sources.objects import canonical, parse, records_of

OBJ, PAGES = "object_key string, size_bytes bigint, body string, pos int, print string, kept boolean", "page_no bigint, keys array<string>"
UUID = "01234567-89ab-cdef-0123-456789abcdef"


@pytest.fixture
def left_out(tmp_path):
    """The copies that a compaction into a new folder leaves out."""
    made = iter(range(99))
    return lambda o, p: compaction.left_out_copies(o, p, f"file://{tmp_path}/out{next(made)}")


def frames(spark, objects, listed):
    return spark.createDataFrame([(k, None, b, 1, "x", None) for k, b in objects], OBJ), spark.createDataFrame([(1, listed), (2, listed[:1]), (3, None), (4, [])], PAGES)


def test_equal_json_values():
    same = ['{"a":1,"b":[1.0,"ü"]}', '{ "b" : [1, "\\u00fc"], "a": 1.00e0 }']
    assert len({canonical(parse(x)) for x in same}) == 1
    different = ["1", '"1"', "true", "null", "[1]", "1.5", '{"a":null}', "{}", "[]", '""', "9007199254740993", "9007199254740992", '"\\ud800"']
    assert len({canonical(parse(x)) for x in different}) == len(different)
    for bad in ("NaN", "[1", "", "-Infinity", "{'a':1}", "[1,]", "[" * 100000):
        with pytest.raises((ValueError, RecursionError)):
            parse(bad)


def test_places_of_records():
    body = '["a",{"v":1},5]\n\nbroken\n["a"]\n7\n["b",null]\r\n'
    assert [(p, i, ts) for p, i, _, ts in records_of("v/c.jsonl", body)] == [(0, '"a"', "5"), (5, '"b"', None)]
    assert list(records_of(f"v/c.mutation.1-{UUID}", "[[")) == [] and list(records_of(f"v/c.mutation.1-{UUID}", "{}")) == []


def test_copies_left_out(spark, rows, left_out):
    m = f"v/c.mutation.1-{UUID}"
    objects = [
        ("v/c.jsonl", '["a",{"x":1,"y":2},5]\nbad\n["a",{"y":2.0,"x":1},5]\n["n",null]\n["n",null,null]'),
        (m, '[["a",{"x":1,"y":2},5],["a",{"x":1,"y":2}],["a",{"x":"1","y":2},5]]'),
        ("v/d.jsonl", '["a",{"x":1,"y":2},5]'), ("v/c.jsonl.tmp", '["a",{"x":1,"y":2},5]'), ("v/c.idx", "{}"), ("w/c.jsonl", '["a",{"x":1,"y":2},5]'), ("v/unlisted.jsonl", '["q",1]\n["q",1]'), ("v/null.jsonl", None), (None, '["a",1]'),
    ]
    o, p = frames(spark, objects, [k for k, _ in objects if k and "unlisted" not in k] + ["v/gone.jsonl", None])
    assert rows(left_out(o, p)) == [("v/c.jsonl", 2), ("v/c.jsonl", 4), (m, 0)]
    assert rows(left_out(o.unionByName(o), p).distinct()) == [("v/c.jsonl", 2), ("v/c.jsonl", 4), (m, 0)]
    assert left_out(o.limit(0), p).count() == 0 and left_out(o, p.limit(0)).count() == 0


def test_against_brute_force(spark, rows, left_out):
    r = random.Random(1)
    objects = []
    for i in range(40):
        recs = [[f"d{r.randint(0, 5)}", r.choice([None, {"a": r.randint(0, 1), "b": 1}, {"b": 1.0, "a": r.randint(0, 1)}]), r.choice([1, 1.0, 2])] for _ in range(6)]
        objects.append((f"v/c.mutation.{i}-{UUID}", json.dumps(recs)) if i % 3 else (f"v/c{i}.jsonl", "\n".join(map(json.dumps, recs))))
    want, seen = [], set()
    for k, b in sorted(objects):
        for pos, rec in enumerate(json.loads(b) if "mutation" in k else map(json.loads, b.split("\n"))):
            mark = (k.split(".")[0], rec[0], None if rec[1] is None else tuple(sorted(rec[1].items())), rec[2])
            if mark in seen:
                want.append((k, pos))
            seen.add(mark)
    o, p = frames(spark, objects, [k for k, _ in objects])
    assert rows(left_out(o, p)) == sorted(want, key=repr)


def test_files_are_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    objects = [(f"v/c{i % 7}.mutation.{i}-{UUID}", json.dumps([[f"d{i}", {"n": i}, i], ["same", {"n": 1}, 1]])) for i in range(200)]
    o, p = frames(spark, objects, [k for k, _ in objects])
    out = f"file://{tmp_path}/out"
    report = compaction.compact_small_files(o, p, out, target_bytes=400)
    assert (report.files_in, report.records_in, report.records_kept, report.records_left_out) == (200, 400, 207, 193)
    assert report.files_out > 3
    got = spark.read.parquet(out)
    assert got.count() == 207 and got.select("volume", "collection", "id", "data", "ts").distinct().count() == 207
    real = compaction._ledger
    monkeypatch.setattr(compaction, "_ledger", lambda df, n=iter(range(9)): real(df).where(f"collection <> 'c{next(n)}'"))
    with pytest.raises(compaction.CountMismatch):
        compaction.compact_small_files(o, p, out)
    assert spark.read.parquet(out).count() == 207 and [n for n, _ in Hdfs(spark, out).files(f"file://{tmp_path}")] == ["out"]


def test_a_swap_cut_short_is_finished(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    fs = Hdfs(spark, out)
    spark.range(3).write.parquet(f"{out}.old")
    compaction.recover(fs, out)
    assert spark.read.parquet(out).count() == 3
    spark.range(5).write.parquet(f"{out}.old")
    compaction.recover(fs, out)
    assert spark.read.parquet(out).count() == 3 and not fs.exists(f"{out}.old")
    o, p = frames(spark, [("v/c.jsonl", "x")], [])
    assert compaction.compact_small_files(o, p, out).records_kept == 0 and spark.read.schema("id string").parquet(out).count() == 0
