import json
import random

import pytest
from pyspark.sql import functions as F

from logstrata.errors import CorruptionError, InvalidNameError, LockActiveError, OptionsMismatchError, SizeLimitError, TransactionError, VectorDimensionError
from logstrata.operators.maintenance import ALWAYS
from logstrata.operators.requests import Requests
from logstrata.operators.store import Hooks, Store, check_name, monotonic_ms
from logstrata.runtime import Hdfs
from logstrata.sources import legacy
from logstrata.streaming.ingest import ingest, windowed_counts


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", rng=random.Random(1), retry_base_s=0)


def test_clock_and_names():
    a = [monotonic_ms() for _ in range(50)]
    assert a == sorted(set(a))
    for good in ("a", "A-1_b", "x" * 64):
        check_name(good)
    for bad in ("", "-a", "a.b", "a/b", "x" * 65, "a\n", None):
        with pytest.raises(InvalidNameError):
            check_name(bad)


def test_changes_time_travel_compaction_and_vacuum(store):
    c = store.collection("docs")
    c.batch(lambda b: [b.put({"id": "1", "n": 1}), b.put({"id": "2", "n": 1}), b.put({"id": "1", "n": 2})])
    early = monotonic_ms()
    c.delete("2")
    c.put({"id": "3", "n": 3, "s": "x"})
    c.batch(lambda b: None)
    assert c.count_pending() == 3
    assert c.get("1") == {"id": "1", "n": 2} and c.get("2") is None and c.get("2", at=early)["n"] == 1
    assert set(c.get_many(["1", "1", "2", "zz"])) == {"1"}
    pinned = c.version()
    for step in ("compact", "vacuum"):
        before = sorted(r.id for r in c.documents().collect())
        result = getattr(c, step)()
        assert sorted(r.id for r in c.documents().collect()) == before == ["1", "3"]
        if step == "compact":
            assert result["mutations_processed"] == 5 and c.count_pending() == 0 and c.get("2", at=early)["n"] == 1
    assert result["records_removed"] == 3 and c.read().count() == 2 and c.get("2", at=early) is None
    assert c.read(pinned).count() == 5
    assert [r.id for r in c.find({"n": 3, "s": "x"}).collect()] == ["3"]
    assert [r.id for r in c.find({"n": "3"}).collect()] == [] and [r.id for r in c.find({"n": 2.0}).collect()] == ["1"]
    assert [r.id for r in c.find(limit=1, offset=1).collect()] == ["3"]
    assert c.expire_versions() > 0 and c.count() == 2


def test_expiry_size_and_options(store):
    c = store.collection("t", ttl="e", size_limit=300)
    c.batch(lambda b: [b.put({"id": "old", "e": 5}), b.put({"id": "new", "e": 10**15}), b.put({"id": "text", "e": "5"}), b.put({"id": "none", "e": None})])
    assert {r.id for r in c.documents().collect()} == {"new", "text", "none"}
    assert c.delete_expired() == 1 and c.delete_expired() == 0
    with pytest.raises(SizeLimitError):
        c.put({"id": "x", "d": "y" * 400})
    with pytest.raises(OptionsMismatchError):
        Store(store.spark, store.root).collection("t")


def test_two_writers_never_overwrite(store):
    a, b = store.collection("w"), Store(store.spark, store.root).collection("w")
    a.put({"id": "1"})
    b.put({"id": "2"})
    assert a.count() == b.count() == 2
    seen = a.manifest()
    b.compact()
    with pytest.raises(LockActiveError):
        a._publish(lambda m: None if m["base"] != seen["base"] else m)


def test_transactions(store):
    c = store.collection("users")
    c.put({"id": "1", "n": 1})

    def fails(tx):
        tx.put("users", {"id": "1", "n": 2})
        tx.put("users", {"id": "2", "n": 2})
        tx.delete("users", "1")
        assert tx.get("users", "2")["n"] == 2
        raise KeyError("no")

    with pytest.raises(TransactionError) as e:
        store.transaction(fails)
    assert isinstance(e.value.cause, KeyError) and not e.value.failures
    assert c.get("1")["n"] == 1 and c.get("2") is None
    assert store.apply([{"type": "put", "collection": "users", "id": "3", "data": {"id": "other", "n": 3}}]) == 1
    assert c.get("3")["n"] == 3 and c.get("other") is None
    with pytest.raises(TransactionError):
        store.apply([{"type": "delete", "collection": "users", "id": "3"}, {"type": "put", "collection": "users", "id": "4"}])
    assert c.get("3")["n"] == 3


def test_vectors(store):
    v = store.vector_collection("v", 2)
    v.put({"id": "a", "vector": [3, 4]})
    assert v.get("a")["vector"] == [0.6, 0.8]
    with pytest.raises(VectorDimensionError):
        v.put({"id": "b", "vector": [1]})
    raw = store.vector_collection("raw", 2, "euclidean")
    raw.put({"id": "a", "vector": [3, 4], "k": "x"})
    assert raw.get("a")["vector"] == [3, 4]
    assert [r.score for r in raw.search([0, 0], where={"k": "x"}).collect()] == [5.0] and raw.search([0, 0], where={"k": "y"}).count() == 0
    assert store.names() == ["raw", "v"]


def test_policy_hooks_and_failures(spark, tmp_path):
    seen = []
    hooks = Hooks(on_write=lambda n, k: seen.append(("w", n, k)), on_compact=lambda n, r: seen.append(("c", n)), on_maintenance_failure=lambda n, o, e, k: seen.append(("f", n, o, k)))
    s = Store(spark, f"file://{tmp_path}/s", hooks, ALWAYS, random.Random(1), maintenance_attempts=2, retry_base_s=0)
    c = s.collection("a")
    c.put({"id": "1"})
    assert seen == [("w", "a", 1), ("c", "a")] and c.count_pending() == 0
    c.compact = lambda: 1 / 0
    c.put({"id": "2"})
    assert seen[-1] == ("f", "a", "compact", 2) and c.count() == 2


def test_legacy_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('["1",{"v":1}]\n\n["2",{"v":1},7]\nnot json\n["1",{"v":2}]\n["3",{"v":1}]\n["2",null]\n[1]\n')
    (tmp_path / "c.mutation.10-x").write_text(json.dumps([["4", {"v": 1}, 10], ["3", None, 10], "x", ["5"]]))
    (tmp_path / "c.mutation.11-x").write_text('[["4",{"v":2},11]')
    (tmp_path / "c.mutation.2-x").write_text(json.dumps([["4", {"v": 9}, 2]]))
    (tmp_path / "other.idx").write_text("{}")
    from logstrata.operators.state import current_state

    log = legacy.read_log(spark, f"file://{tmp_path}", "c")
    got = {r.id: r.v for r in current_state(log).select("id", F.try_variant_get("data", "$.v", "int").alias("v")).collect()}
    assert got == {"1": 2, "4": 9}  # pending files are in order of their names
    assert log.count() == 8
    assert legacy.list_collections(spark, f"file://{tmp_path}") == ["c", "other"]
    assert legacy.count_pending_files(spark, f"file://{tmp_path}", "c") == 3
    assert legacy.read_log(spark, f"file://{tmp_path}", "none").count() == 0


def test_streaming_ingestion(spark, tmp_path, store):
    src = str(tmp_path / "src")
    schema = "id string, n int, gone boolean"
    spark.createDataFrame([("a", 1, False), ("b", 2, None)], schema).write.parquet(src)
    c = store.collection("s")
    run = lambda: ingest(spark.readStream.schema(schema).parquet(src), c, str(tmp_path / "cp"), "gone").awaitTermination()
    run()
    spark.createDataFrame([("a", None, True), ("c", 3, False)], schema).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in c.documents().collect()) == ["b", "c"]


def test_windows_drop_late_rows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:01", "k"), ("2024-01-01 00:00:09", "k"), ("2024-01-01 00:10:00", "k")], "t string, k string").selectExpr("to_timestamp(t) AS t", "k").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "e")), "t", ["k"], "10 seconds", "1 minute")
    q = s.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "wcp")).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [2]


def test_exclusive_create(spark, tmp_path):
    fs = Hdfs(spark, f"file://{tmp_path}")
    assert fs.create(f"file://{tmp_path}/x", "1") and not fs.create(f"file://{tmp_path}/x", "2")
    assert fs.read_text(f"file://{tmp_path}/x") == "1"


def test_a_half_written_manifest_is_told(store):
    c = store.collection("m")
    c.put({"id": "1"})
    newest = c._manifest_path(c.version() + 1)
    out = c._fs._fs.create(c._fs._p(newest), False)  # as a writer that isn't ours might leave it
    out.write(bytearray(b'{"base": ['))
    out.close()
    with pytest.raises(CorruptionError):
        c.count()
    assert c.read(2).count() == 1


def test_created_files_are_whole_and_exclusive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    fs = Hdfs(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: fs.create(f"file://{tmp_path}/x", str(i) * 1000), range(8)))
    assert sum(won) == 1 and fs.read_text(f"file://{tmp_path}/x") == str(won.index(True)) * 1000
    assert [n for n, _ in fs.files(f"file://{tmp_path}") if n != "x"] == [] and fs.size(f"file://{tmp_path}/x") == 1000 and fs.size(f"file://{tmp_path}/y") is None


def test_compaction_is_cut_by_the_bytes_that_are_pending(spark, store, monkeypatch):
    from logstrata.operators import store as module

    c = store.collection("big")
    c.put_df(spark.range(4000).selectExpr("CAST(id AS STRING) AS id", "sha2(CAST(id AS STRING), 256) AS h"))
    monkeypatch.setattr(module, "BASE_FILE", 60_000)
    c.compact()
    base = c.manifest()["base"][0]
    assert len([n for n, _ in c._fs.files(f"{c.root}/{base}") if n.endswith(".parquet")]) >= 4
    assert c.count() == 4000 and store.stats("big")["size"] > 60_000


def test_bulk_writes_have_the_limit_of_size_for_each_document(spark, store):
    c = store.collection("l", size_limit=200)
    c.put_df(spark.range(50).selectExpr("CAST(id AS STRING) AS id", "repeat('x', 100) AS t"))
    with pytest.raises(SizeLimitError) as e:
        c.put_df(spark.range(5).selectExpr("CAST(id AS STRING) AS id", "repeat('x', CAST(100 * id AS INT)) AS t"))
    assert e.value.limit == 200 and e.value.size > 200 and c.count() == 50


def test_a_lease_keeps_a_second_maintainer_out(store):
    c = store.collection("k")
    c.put({"id": "1"})
    with c.lease():
        with pytest.raises(LockActiveError):
            c.compact()
    assert c.compact()["bloom_filter_built"] and not c.compact()["index_built"]
    # one that has lapsed is taken over
    names = [n for n, _ in c._fs.files(f"{c.root}/lease")]
    c._fs.create(c._lease_path(int(names[-1][:-5]) + 1), json.dumps({"session": "dead", "expires_at": monotonic_ms() - 1000}))
    c.put({"id": "2"})
    assert c.compact()["mutations_processed"] == 1 and c.vacuum()["records_removed"] == 0


def test_scheduled_maintenance(store):
    import time

    c = store.collection("timed")
    c.put({"id": "1"})
    c.start_maintenance(compact_every_s=0.1)
    for _ in range(200):
        time.sleep(0.1)
        if c.count_pending() == 0:
            break
    c.stop_maintenance()
    c.stop_maintenance()
    assert c.count_pending() == 0 and c.get("1") == {"id": "1"}
    errors = []
    store.hooks.on_error = errors.append
    c.compact = lambda: 1 / 0
    c.start_maintenance(compact_every_s=0.01)
    time.sleep(0.3)
    c.stop_maintenance()
    assert errors and isinstance(errors[0], ZeroDivisionError)


def test_a_read_as_of_a_time_opens_only_commits_of_that_time(store):
    c = store.collection("p")
    times = []
    for n in range(4):
        c.put({"id": "a", "n": n})
        times.append(monotonic_ms())
    assert [len(c.read(at=t).inputFiles()) for t in times] == [1, 2, 3, 4]
    assert [c.get("a", at=t)["n"] for t in times] == [0, 1, 2, 3] and c.count(at=times[0] - 10**6) == 0
    c.compact()
    assert [c.get("a", at=t)["n"] for t in times] == [0, 1, 2, 3]


def test_many_ids_and_counts(spark, store):
    c = store.collection("many", ttl="e")
    c.put_df(spark.range(1500).selectExpr("CAST(id AS STRING) AS id", "id AS e"))
    assert len(c.get_many([str(i) for i in range(5000)], now=0)) == 1500
    assert c.count(now=1000) == 500 and store.existing("many").options.ttl == "e"
    with pytest.raises(KeyError):
        store.stats("none")


def test_a_transaction_undoes_a_write_whose_hook_raised(store):
    c = store.collection("h")
    c.put({"id": "1", "n": 1})

    def once(*_):
        store.hooks.on_write = None
        raise OSError("hook")

    store.hooks.on_write = once
    with pytest.raises(TransactionError):
        store.transaction(lambda tx: tx.put(c, {"id": "1", "n": 2}))
    assert c.get("1")["n"] == 1


def test_requests(store):
    r = Requests(store, query=lambda docs, q: docs.where(F.try_variant_get("doc", "$.n", "int") > int(q)))
    for i in range(25):
        r.put("d", f"x{i:02d}", {"id": "other", "n": i, "b": i % 2 == 0, "t": str(i % 3)})
    first = r.list("d")
    assert [x["id"] for x in first["data"]] == [f"x{i:02d}" for i in range(20)] and first["pagination"] == {"limit": 20, "offset": 0, "has_more": True}
    assert [x["n"] for x in r.list("d", {"b": "true", "offset": "10", "limit": "nan"})["data"]] == [20, 22, 24]
    assert [x["n"] for x in r.list("d", {"t": "2", "limit": "2"})["data"]] == [2, 5] and r.list("d", {"n": "7.0"})["data"][0]["n"] == 7
    assert r.list("d", {"n": "true"})["data"] == [] and r.list("d", {"nope": "1"})["data"] == [] and len(r.list("d", {"prefix": "x1", "limit": "500"})["data"]) == 10
    assert [x["n"] for x in r.list("d", {"q": "22"})["data"]] == [23, 24]
    assert r.delete("d", "x00") == {"id": "x00", "deleted": True} and r.delete("d", "unknown")["deleted"]
    with pytest.raises(KeyError):
        r.get("d", "x00")
    with pytest.raises(KeyError):
        r.get("none", "x")
    assert r.collections() == ["d"] and r.compact("d")["mutations_processed"] == 27 and r.stats("d")["count"] == 24 and r.vacuum("d")["records_removed"] == 3
    v = store.vector_collection("v", 2)
    v.batch(lambda b: [b.put({"id": f"{i:03d}", "vector": [1, i]}) for i in range(120)])
    assert len(r.search("v", {"vector": [1, 0]})) == 10 and len(r.search("v", {"vector": [1, 0], "k": 1000})) == 100
    assert r.search("v", {"vector": [1, 0], "k": 1})[0] == {"id": "000", "score": 1.0, "data": {"id": "000"}}
    for bad in ({"vector": [1, 0], "k": -1}, {"vector": [1, 0], "k": "3"}):
        with pytest.raises(ValueError):
            r.search("v", bad)
    with pytest.raises(OptionsMismatchError):
        r.search("v", {"vector": [1, 0], "metric": "euclidean"})


def test_ingestion_keeps_order_and_applies_a_batch_once(spark, tmp_path, store):
    c = store.collection("i")
    schema = "id string, n int, gone boolean, at int"
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1, False, 1), ("a", None, True, 2), ("a", 3, False, 3), ("b", 1, False, 1), ("b", None, True, 9), (None, 1, False, 1)], schema).write.parquet(src)
    ingest(spark.readStream.schema(schema).parquet(src), c, str(tmp_path / "cp"), "gone", "at").awaitTermination()
    assert [(r.id, json.loads(r.data)["n"]) for r in c.documents().collect()] == [("a", 3)] and c.count_pending() == 1
    # the batch comes again after a later write of another writer
    c.put({"id": "a", "n": 4})
    c.write_df(spark.createDataFrame([("a", 3)], "id string, n int"), stream=(str(tmp_path / "cp"), 0))
    assert c.get("a")["n"] == 4 and c.count_pending() == 2
    c.write_df(spark.createDataFrame([("a", 5)], "id string, n int"), stream=(str(tmp_path / "cp"), 1))
    assert c.get("a")["n"] == 5
