"""A store of collections on any Hadoop filesystem: immutable Parquet commits under a versioned manifest.

A collection is a folder with ``data/<uuid>`` folders, each the result of one commit, and ``manifest/<n>.json``, which names the
folders that make up version n: compacted ones (base) and pending ones (delta), each with its time and bytes. A commit writes its
data first and then creates the next manifest exclusively and whole, so it appears as a whole or not at all, writers never overwrite
each other, and a reader that has picked a version is never disturbed. A read as of a time opens only commits of that time or
before. Old folders are removed by `expire_versions` only.

Maintenance holds a lease, ``lease/<n>.json``, whose newest number counts: it's taken where the newest has lapsed or was given up, by
creating the next one exclusively. A lease that lapses during its work does no harm, as the result is published against the base that
it was made from.
"""

from __future__ import annotations

import json
import logging
import random
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import (
    CorruptionError, InvalidNameError, LockAcquisitionError, LockActiveError, OptionsMismatchError, SizeLimitError, TransactionError,
)
from ..functions import vectors as V
from ..functions.predicates import Where, strict_equals_variant
from ..runtime import Hdfs
from . import maintenance, query, state
from .maintenance import NEVER, Policy
from .search import METRICS, check_vector, request_size, search

log = logging.getLogger("logstrata.store")

# A collection's name, and the largest batch in characters of JSON.
NAME = re.compile(r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}\Z")
SIZE_LIMIT = 10 * 1024 * 1024
#: Attempts to publish a commit that others' commits overtake.
ATTEMPTS = 20

#: Bytes of a file of the base that are aimed at.
BASE_FILE = 256 << 20

_TOO_LONG = "a document is too long: "
STORED = "id string, deleted boolean, ts bigint, ord struct<seq:bigint,pos:bigint>, data string, vector array<double>"

_clock = {"last": 0}


def monotonic_ms() -> int:
    """Epoch-ms, higher than any returned before by this process."""
    _clock["last"] = max(int(time.time() * 1000), _clock["last"] + 1)
    return _clock["last"]


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.match(name):
        raise InvalidNameError(f"not a collection's name: {name!r}")
    return name


@dataclass
class Hooks:
    """What is called after a commit, a compaction or vacuum, an error, and a maintenance that failed for good."""

    on_write: Callable[[str, int], None] | None = None
    on_compact: Callable[[str, dict], None] | None = None
    on_vacuum: Callable[[str, dict], None] | None = None
    on_error: Callable[[BaseException], None] | None = None
    on_maintenance_failure: Callable[[str, str, BaseException, int], None] | None = None


@dataclass
class Options:
    """Fixed when the collection is made and kept in its manifest; ttl names a top-level field of epoch-ms."""

    ttl: str | None = None
    dimension: int | None = None
    metric: str = "cosine"
    normalize: bool | None = None
    size_limit: int = SIZE_LIMIT

    def normalizes(self) -> bool:
        return self.metric == "cosine" if self.normalize is None else self.normalize


@dataclass
class Batch:
    """Operations of one commit; of two on the same id the later one counts."""

    ops: list[tuple[str, dict | None]] = field(default_factory=list)

    def put(self, doc: dict) -> None:
        if not isinstance(doc.get("id"), str):
            raise ValueError("a document has a string id")
        self.ops.append((doc["id"], doc))

    def delete(self, id: str) -> None:
        self.ops.append((id, None))


class Collection:
    def __init__(self, store: Store, name: str, options: Options):
        self.store, self.name, self.options = store, name, options
        self.spark = store.spark
        self.root = f"{store.root}/{name}"
        self._stop: threading.Event | None = None
        self._workers: list[threading.Thread] = []
        self._fs = Hdfs(self.spark, store.root)
        self._fs.mkdirs(f"{self.root}/manifest")
        if self.version() == 0:
            first = {"options": options.__dict__, "base": [], "delta": [], "base_bytes": 0, "seq": 0, "streams": {}}
            self._fs.create(self._manifest_path(1), json.dumps(first))
        if (kept := self.manifest()["options"]) != options.__dict__:
            raise OptionsMismatchError(f"{name} was made with {kept}")

    # manifest

    def _manifest_path(self, n: int) -> str:
        return f"{self.root}/manifest/{n:012d}.json"

    def version(self) -> int:
        names = [n for n, _ in self._fs.files(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1][:-5]) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        path = self._manifest_path(version or self.version())
        try:
            return json.loads(self._fs.read_text(path))
        except ValueError as e:
            raise CorruptionError(f"{path} is no manifest") from e

    def _publish(self, change: Callable[[dict], dict | None], attempts: int = ATTEMPTS) -> dict:
        """Create the next manifest from the newest one; ``change`` returns None to give up."""
        for _ in range(attempts):
            n = self.version()
            new = change(self.manifest(n))
            if new is None:
                raise LockActiveError(f"{self.name} was changed by another writer")
            if self._fs.create(self._manifest_path(n + 1), json.dumps(new)):
                return new
        raise LockActiveError(f"{self.name} is being written by others")

    # writing

    def _rows(self, ops: Iterable[tuple[str, dict | None]], ts: int) -> list[tuple]:
        rows, size = [], 0
        for pos, (id, doc) in enumerate(ops):
            vector, text = None, None
            if doc is not None:
                body = dict(doc)
                if self.options.dimension is not None:
                    vector = check_vector(body.pop("vector", None), self.options.dimension)
                    if self.options.normalizes():
                        norm = sum(x * x for x in vector) ** 0.5
                        vector = [x / norm for x in vector] if norm else vector
                text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
                size += len(text) + 20 * len(vector or ())
            size += len(id) + 32
            rows.append((id, doc is None, ts, pos, text, vector))
        if size > self.options.size_limit:
            raise SizeLimitError(size, self.options.size_limit)
        return rows

    def _append(self, df: DataFrame, count: int, ts: int, stream: tuple[str, int] | None = None) -> None:
        """Write ``(id, deleted, ts, pos, data, vector)`` as one commit. Its place in the order is given by the manifest. ``stream``,
        a name and a number, makes it the commit of that number: it isn't made again if it or a later one was."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        size, done = self._fs.bytes_in(f"{self.root}/{folder}"), []

        def add(m: dict) -> dict:
            if stream and m["streams"].get(stream[0], -1) >= stream[1]:
                done.append(True)
                return m
            entry = {"path": folder, "seq": m["seq"] + 1, "rows": count, "ts": ts, "bytes": size}
            return m | {"seq": m["seq"] + 1, "delta": [*m["delta"], entry], "streams": m["streams"] | dict([stream] if stream else [])}

        self._publish(add)
        if done:
            self._fs.delete(f"{self.root}/{folder}")
            return
        if self.store.hooks.on_write:
            self.store.hooks.on_write(self.name, count)
        self._maintain()

    def put(self, doc: dict) -> None:
        self.batch(lambda b: b.put(doc))

    def delete(self, id: str) -> None:
        self.batch(lambda b: b.delete(id))

    def batch(self, fill: Callable[[Batch], None]) -> None:
        """One atomic commit of several operations; an empty batch writes nothing."""
        b = Batch()
        fill(b)
        if b.ops:
            ts = monotonic_ms()
            rows = self._rows(b.ops, ts)
            made = self.spark.createDataFrame(rows, "id string, deleted boolean, ts bigint, pos bigint, data string, vector array<double>")
            self._append(made.coalesce(1), len(rows), ts)  # one file

    def put_df(self, df: DataFrame) -> None:
        """One atomic commit of a frame of any size: a row per document, with ``id`` and any columns. The limit of size holds for each
        document."""
        self.write_df(df)

    def write_df(self, df: DataFrame, deleted: Column | None = None, order: Column | None = None, stream: tuple[str, int] | None = None) -> None:
        """`put_df`, where rows that ``deleted`` holds for delete their id, and of several rows of one id the one that is highest in
        ``order`` counts (by default the last one of the frame). ``stream`` as in `_append`."""
        ts = monotonic_ms()
        place = F.monotonically_increasing_id() if order is None else order
        docs = df.withColumns({"__pos": place, "__gone": F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))}).where(F.col("id").isNotNull())
        if order is not None:  # the place is a number below; any orderable value gets one by keeping the highest of each id
            w = Window.partitionBy("id").orderBy(F.desc_nulls_last("__pos"), F.desc("__gone"))
            docs = docs.withColumn("__n", F.row_number().over(w)).where("__n = 1").withColumn("__pos", F.lit(0).cast("bigint")).drop("__n")
        vector: Column = F.lit(None).cast("array<double>")
        if self.options.dimension is not None:
            ok = F.assert_true(V.is_valid("vector", self.options.dimension), F.lit("a vector isn't valid"))
            v = V.normalize("vector") if self.options.normalizes() else F.col("vector").cast("array<double>")
            vector = F.when(ok.isNull(), v)
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "vector" or self.options.dimension is None]))
        rows = docs.select(F.col("id").cast("string").alias("id"), F.col("__gone").alias("deleted"), F.lit(ts).cast("bigint").alias("ts"), F.col("__pos").alias("pos"),
                           F.when(~F.col("__gone"), body).alias("data"), F.when(~F.col("__gone"), vector).alias("vector"))
        length = F.length("data") + 20 * F.coalesce(F.size("vector"), F.lit(0)) + F.length("id") + 32
        within = F.assert_true((length <= self.options.size_limit) | F.col("deleted"), F.concat(F.lit(_TOO_LONG), length.cast("string"), F.lit(";")))
        rows = rows.withColumn("data", F.when(within.isNull(), F.col("data")))
        try:
            self._append(rows, -1, ts, stream)
        except Exception as e:
            if found := re.search(re.escape(_TOO_LONG) + r"(\d+);", str(e)):
                raise SizeLimitError(int(found[1]), self.options.size_limit) from e
            raise

    def delete_df(self, ids: DataFrame) -> None:
        """One atomic commit that deletes the ids in the first column of ``ids``."""
        ts = monotonic_ms()
        rows = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).where("id is not null").select(
            "id", F.lit(True).alias("deleted"), F.lit(ts).cast("bigint").alias("ts"), F.monotonically_increasing_id().alias("pos"),
            F.lit(None).cast("string").alias("data"), F.lit(None).cast("array<double>").alias("vector"))
        self._append(rows, -1, ts)

    # reading

    def _read(self, entries: list[dict]) -> DataFrame:
        """Pending commits; the sequence of each comes from the manifest by the name of its folder."""
        if not entries:
            return self.spark.createDataFrame([], STORED)
        kind = "id string, deleted boolean, ts bigint, pos bigint, data string, vector array<double>"
        raw = self.spark.read.schema(kind).parquet(*[f"{self.root}/{e['path']}" for e in entries])
        where = F.regexp_extract(F.col("_metadata.file_path"), r"data/([0-9a-f]{32})/", 1)
        seqs = self.spark.createDataFrame([(e["path"][5:], e["seq"]) for e in entries], "commit string, seq bigint")
        return raw.withColumn("commit", where).join(F.broadcast(seqs), "commit").select(  # one row per pending commit
            "id", "deleted", "ts", F.struct("seq", "pos").alias("ord"), "data", "vector")

    def read(self, version: int | None = None, at: int | None = None) -> DataFrame:
        """Every stored version, deletions included, as a log; with ``at`` that of the commits of that time or before, so that later
        ones aren't opened."""
        m = self.manifest(version)
        if at is None:
            return self._whole(m)
        return state.as_of(self._whole(m | {"delta": [e for e in m["delta"] if e["ts"] <= at]}), at)

    def _expiring(self, log_: DataFrame) -> DataFrame:
        """With column ``__ttl``: the ttl field where it's a number, else null, which never expires."""
        path = self.options.ttl
        if path is None:
            return log_
        doc = F.try_parse_json("data")
        field_ = F.try_variant_get(doc, f"$['{path}']", "variant")
        number = F.schema_of_variant(field_).isin("BIGINT", "DOUBLE", "FLOAT") | F.schema_of_variant(field_).startswith("DECIMAL")
        return log_.withColumn("__ttl", F.when(number, F.try_variant_get(doc, f"$['{path}']", "double")))

    def documents(self, at: int | None = None, now: int | None = None, version: int | None = None) -> DataFrame:
        """``(id, data, vector, ts, first_seen)`` of the live documents."""
        rows = self._expiring(self.read(version, at))
        ttl = "__ttl" if self.options.ttl else None
        return state.with_first_seen(rows, at, monotonic_ms() if now is None else now, ttl).drop("deleted", "__ttl")

    def _doc(self, row) -> dict:
        doc = json.loads(row["data"])
        if row["vector"] is not None:
            doc["vector"] = list(row["vector"])
        return doc

    def get(self, id: str, at: int | None = None, now: int | None = None) -> dict | None:
        rows = self._expiring(self.read(at=at).where(F.col("id") == id))
        found = state.current_state(rows, at, monotonic_ms() if now is None else now, "__ttl" if self.options.ttl else None).take(1)
        return self._doc(found[0]) if found else None

    def get_many(self, ids: list[str], at: int | None = None, now: int | None = None) -> dict[str, dict]:
        found = query.get_many(self._expiring(self.read(at=at)), list(dict.fromkeys(ids)), at, monotonic_ms() if now is None else now, "__ttl" if self.options.ttl else None)
        return {r["id"]: self._doc(r) for r in found.toLocalIterator()}

    def find(self, where: Where = None, limit: int | None = None, offset: int = 0, at: int | None = None, now: int | None = None, include_vector: bool = False) -> DataFrame:
        """Live documents as ``(id, data, ...)``, with ``limit`` or ``offset`` in order of first appearance. A mapping compares fields of the JSON without
        coercion; a column, SQL text or function sees ``doc``, the document as VARIANT."""
        docs = self.documents(at, now).withColumn("doc", F.try_parse_json("data"))
        if isinstance(where, dict):
            cond = F.lit(True)
            for k, v in where.items():
                cond = cond & strict_equals_variant(F.col("doc"), k, v)
        else:
            cond = F.lit(True) if where is None else where if isinstance(where, Column) else F.expr(where) if isinstance(where, str) else where(docs)
        out = docs.where(cond).drop("doc")
        if offset or limit is not None:
            out = out.orderBy("first_seen", "id")
        if offset:
            out = out.offset(offset)
        if limit is not None:
            out = out.limit(limit)
        return out if include_vector else out.drop("vector")

    def count(self, at: int | None = None, now: int | None = None) -> int:
        rows = self._expiring(self.read(at=at)).drop("vector")
        rows = rows if self.options.ttl is None else rows.drop("data")
        return state.count_live(rows, at, monotonic_ms() if now is None else now, "__ttl" if self.options.ttl else None).first()[0]

    def search(self, query: list[float], k: int | None = 10, threshold: float | None = None, where: Where = None, include_vector: bool = False, now: int | None = None) -> DataFrame:
        """Top k of the collection's metric over ``(id, data)``; only for collections with a dimension."""
        if self.options.dimension is None:
            raise ValueError(f"{self.name} has no vectors")
        rows = self._expiring(self.read())
        cond: Where = where
        if isinstance(where, dict):
            def cond(df):
                out = F.lit(True)
                for name, v in where.items():
                    out = out & strict_equals_variant(F.try_parse_json("data"), name, v)
                return out
        ttl = "__ttl" if self.options.ttl else None
        return search(rows, query, self.options.dimension, k, self.options.metric, threshold, cond, monotonic_ms() if now is None else now, ttl, include_vector).drop("__ttl")

    def request_search(self, request: dict, now: int | None = None) -> DataFrame:
        """`search` by ``{vector, k, metric}``: k is 10 by default and at most 100; another metric than the collection's is refused."""
        if (metric := request.get("metric", self.options.metric)) != self.options.metric:
            raise OptionsMismatchError(f"{self.name} is searched by {self.options.metric}, not {metric}")
        return self.search(request.get("vector"), request_size(request.get("k")), now=now)

    # maintenance

    def _lease_path(self, n: int) -> str:
        return f"{self.root}/lease/{n:012d}.json"

    @contextmanager
    def lease(self, vacuum: bool = False) -> Iterator[None]:
        """Hold the collection's maintenance lease, for as long as the work ahead is estimated to take."""
        self._fs.mkdirs(f"{self.root}/lease")
        m, session = self.manifest(), uuid.uuid4().hex
        names = [n for n, _ in self._fs.files(f"{self.root}/lease") if n.endswith(".json") and not n.startswith(".")]
        last = int(names[-1][:-5]) if names else 0
        if last and (until := json.loads(self._fs.read_text(self._lease_path(last)))["expires_at"]) > (now := monotonic_ms()):
            raise LockActiveError(f"{self.name} is being maintained for another {until - now} ms at most")
        until = monotonic_ms() + maintenance.lease_ms(m["base_bytes"], len(m["delta"]), vacuum)
        try:
            mine = self._fs.create(self._lease_path(last + 1), json.dumps({"session": session, "expires_at": until}))
        except Exception as e:
            raise LockAcquisitionError(f"the lease of {self.name} can't be written") from e
        if not mine:
            raise LockActiveError(f"{self.name} has just been leased by another")
        try:
            yield
        finally:
            if self._fs.create(self._lease_path(last + 2), json.dumps({"session": session, "expires_at": 0})):
                for n in names[:-1]:
                    self._fs.delete(f"{self.root}/lease/{n}")

    def count_pending(self) -> int:
        return len(self.manifest()["delta"])

    def stats(self) -> dict:
        m = self.manifest()
        return {"collection": self.name, "count": self.count(), "size": m["base_bytes"]}

    def _rewrite(self, make: Callable[[dict], DataFrame], delta_taken: bool) -> tuple[str, dict]:
        """Write a new base of the newest version and publish it, unless another base was published meanwhile."""
        seen = self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        size = max(1, -(-(seen["base_bytes"] + delta_taken * sum(e["bytes"] for e in seen["delta"])) // BASE_FILE))
        rows = make(seen).repartitionByRange(size, "id", "ord").sortWithinPartitions("id", "ord")
        rows.write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.root}/{folder}")
        written = self._fs.bytes_in(f"{self.root}/{folder}")

        def swap(m: dict) -> dict | None:
            if m["base"] != seen["base"]:
                return None
            taken = {e["path"] for e in seen["delta"]} if delta_taken else set()
            return m | {"base": [folder], "base_bytes": written, "delta": [e for e in m["delta"] if e["path"] not in taken]}

        self._publish(swap)
        return folder, seen

    def compact(self) -> dict:
        """Pending commits into the base, all versions kept. Nothing changes for readers, now or at any earlier time. The base is
        sorted by id, which is its index, and has a Bloom filter of the ids; both are told as built if the base was written."""
        began = time.time()
        with self.lease():
            if not self.manifest()["delta"]:
                return {"mutations_processed": 0, "duration_ms": 0, "bloom_filter_built": False, "index_built": False}
            _, seen = self._rewrite(lambda m: self._whole(m), True)
            n = self._read(seen["delta"]).count()
        result = {"mutations_processed": n, "duration_ms": int((time.time() - began) * 1000), "bloom_filter_built": True, "index_built": True}
        if self.store.hooks.on_compact:
            self.store.hooks.on_compact(self.name, result)
        return result

    def _whole(self, m: dict) -> DataFrame:
        base = self._base(m)
        return base.unionByName(self._read(m["delta"])) if m["delta"] else base

    def _base(self, m: dict) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*[f"{self.root}/{p}" for p in m["base"]]) if m["base"] else self.spark.createDataFrame([], STORED)

    def vacuum(self) -> dict:
        """Of the base only the last version of each id stays, and none of a deleted one; pending commits are left alone."""
        began = time.time()
        with self.lease(vacuum=True):
            if not self.manifest()["base"]:
                return {"records_removed": 0, "duration_ms": 0}
            folder, seen = self._rewrite(lambda x: maintenance.vacuumed(self._base(x)), False)
            before = self._base(seen).count()
            after = self.spark.read.schema(STORED).parquet(f"{self.root}/{folder}").count()
        result = {"records_removed": before - after, "duration_ms": int((time.time() - began) * 1000)}
        if self.store.hooks.on_vacuum:
            self.store.hooks.on_vacuum(self.name, result)
        return result

    def delete_expired(self, now: int | None = None) -> int:
        if self.options.ttl is None:
            return 0
        rows = self._expiring(self.read())
        gone = state.expired(rows, monotonic_ms() if now is None else now, "__ttl").select("id")
        n = gone.count()
        if n:
            self.delete_df(gone)
        return n

    def expire_versions(self, keep: int = 1) -> int:
        """Remove manifests but the newest ``keep``, and folders that none of those names. Readers of older versions break."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = set()
        for n in kept:
            m = self.manifest(n)
            used |= {p.split("/")[1] for p in m["base"]} | {e["path"].split("/")[1] for e in m["delta"]}
        removed = 0
        for n in range(1, kept[0]):
            self._fs.delete(self._manifest_path(n))
        for name, _ in self._fs.files(f"{self.root}/data"):
            if name not in used:
                self._fs.delete(f"{self.root}/data/{name}")
                removed += 1
        return removed

    def start_maintenance(self, compact_every_s: float | None = None, vacuum_every_s: float | None = None) -> None:
        """Compact and vacuum at intervals, in threads of the driver, until `stop_maintenance`. Conflicts are passed over, other
        failures go to on_error."""
        self.stop_maintenance()
        self._stop = stop = threading.Event()

        def work(name: str, every: float) -> None:
            while not stop.wait(every):
                try:
                    getattr(self, name)()
                except LockActiveError:
                    pass
                except Exception as e:
                    log.warning("%s of %s failed: %s", name, self.name, e)
                    if self.store.hooks.on_error:
                        self.store.hooks.on_error(e)

        self._workers = [threading.Thread(target=work, args=(n, s), daemon=True) for n, s in (("compact", compact_every_s), ("vacuum", vacuum_every_s)) if s is not None]
        for t in self._workers:
            t.start()

    def stop_maintenance(self) -> None:
        """Stop what `start_maintenance` started; waits for work that is under way."""
        if self._stop is not None:
            self._stop.set()
            for t in self._workers:
                t.join()
            self._stop, self._workers = None, []

    def _maintain(self) -> None:
        """What the policy asks for after a commit. Conflicts are passed over; other failures are retried, then reported."""
        policy, rng = self.store.policy, self.store.rng
        done = policy.compacts(self.count_pending(), rng) if policy is not NEVER else False
        todo = ["compact"] * done + ["vacuum"] * (policy is not NEVER and policy.vacuums(done, rng))
        for name in todo:
            for attempt in range(1, self.store.maintenance_attempts + 1):
                try:
                    getattr(self, name)()
                    break
                except LockActiveError:
                    break
                except Exception as e:
                    log.warning("%s of %s failed, attempt %d: %s", name, self.name, attempt, e)
                    if attempt == self.store.maintenance_attempts:
                        if self.store.hooks.on_error:
                            self.store.hooks.on_error(e)
                        if self.store.hooks.on_maintenance_failure:
                            self.store.hooks.on_maintenance_failure(self.name, name, e, attempt)
                    else:
                        time.sleep(self.store.retry_base_s * 2 ** (attempt - 1) * rng.uniform(0.5, 1))


class Transaction:
    """Writes that are undone in reverse order if the transaction fails; they are visible meanwhile."""

    def __init__(self, store: Store):
        self.store = store
        self._undo: list[Callable[[], None]] = []

    def put(self, collection: str | Collection, doc: dict) -> None:
        c = self.store._of(collection)
        before = c.get(doc["id"])
        # noted first: a hook may raise after the write
        self._undo.append((lambda: c.put(before)) if before is not None else (lambda: c.delete(doc["id"])))
        c.put(doc)

    def delete(self, collection: str | Collection, id: str) -> None:
        c = self.store._of(collection)
        before = c.get(id)
        if before is not None:
            self._undo.append(lambda: c.put(before))
        c.delete(id)

    def get(self, collection: str | Collection, id: str) -> dict | None:
        return self.store._of(collection).get(id)

    def transaction(self, body: Callable[[Transaction], object]) -> object:
        """A savepoint: its failure undoes only its own writes; after success they belong to this transaction."""
        inner = Transaction(self.store)
        result = inner._run(body)
        self._undo += inner._undo
        return result

    def _run(self, body: Callable[[Transaction], object]) -> object:
        try:
            return body(self)
        except Exception as cause:
            failures: list[BaseException] = []
            for undo in reversed(self._undo):
                try:
                    undo()
                except Exception as e:
                    failures.append(e)
            self._undo = []
            raise TransactionError(cause, failures) from cause


class Store:
    """All collections below one folder."""

    def __init__(self, spark: SparkSession, root: str, hooks: Hooks | None = None, policy: Policy = NEVER, rng: random.Random | None = None,
                 maintenance_attempts: int = 3, retry_base_s: float = 1.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.hooks, self.policy, self.rng = hooks or Hooks(), policy, rng or random.Random()
        self.maintenance_attempts, self.retry_base_s = maintenance_attempts, retry_base_s
        self._open: dict[str, Collection] = {}

    def collection(self, name: str, ttl: str | None = None, size_limit: int = SIZE_LIMIT) -> Collection:
        return self._opened(name, Options(ttl=ttl, size_limit=size_limit))

    def vector_collection(self, name: str, dimension: int, metric: str = "cosine", normalize: bool | None = None, ttl: str | None = None, size_limit: int = SIZE_LIMIT) -> Collection:
        if metric not in METRICS:
            raise ValueError(f"no such metric: {metric}")
        return self._opened(name, Options(ttl, dimension, metric, normalize, size_limit))

    def _opened(self, name: str, options: Options) -> Collection:
        if name in self._open and self._open[name].options == options:
            return self._open[name]
        self._open[name] = c = Collection(self, check_name(name), options)
        return c

    def _of(self, c: str | Collection) -> Collection:
        if isinstance(c, Collection):
            return c
        return self._open[c] if c in self._open else self.collection(c)

    def names(self) -> list[str]:
        fs = Hdfs(self.spark, self.root)
        return [n for n, _ in fs.files(self.root) if NAME.match(n) and fs.exists(f"{self.root}/{n}/manifest")]

    def stats(self, name: str) -> dict:
        """``{collection, count, size}`` of a collection that exists."""
        return self.existing(name).stats()

    def existing(self, name: str) -> Collection:
        """A collection with the options it was made with."""
        if check_name(name) not in self.names():
            raise KeyError(name)
        fs = Hdfs(self.spark, self.root)
        newest = [n for n, _ in fs.files(f"{self.root}/{name}/manifest") if not n.startswith(".")][-1]
        return self._opened(name, Options(**json.loads(fs.read_text(f"{self.root}/{name}/manifest/{newest}"))["options"]))

    def transaction(self, body: Callable[[Transaction], object]) -> object:
        """Run ``body``; if it raises, its writes are undone and `TransactionError` is raised."""
        return Transaction(self)._run(body)

    def apply(self, ops: list[dict], limit: int = 50) -> int:
        """A transaction given as data: ``{type: put | delete, collection, id, data}``; any other type, or a put without data,
        undoes all of it."""
        if len(ops) > limit:
            raise ValueError(f"at most {limit} operations")

        def body(tx: Transaction) -> int:
            for op in ops:
                if op.get("type") == "put" and isinstance(op.get("data"), dict):
                    tx.put(op["collection"], {**op["data"], "id": op["id"]})
                elif op.get("type") == "delete":
                    tx.delete(op["collection"], op["id"])
                else:
                    raise ValueError(f"not an operation: {op.get('type')!r}")
            return len(ops)

        return self.transaction(body)
