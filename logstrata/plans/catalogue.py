"""The queries of the document-log operators over the event, order and embedding tables, and their SQL.

EV is `events` as a change log (id = user, an error event deletes, stored in order of event_id), EVX adds an expiry 12 hours after
each event, VEC is `embeddings` with later versions (every 10th vector negated, every 17th deleted), ORD is `orders` as documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.predicates import parameters_column
from ..operators import maintenance, query, search, state
from ..sources.tables import table

#: 2024-01-15, 2024-01-08, 2024-01-22 and 2024-01-31, in epoch-ms.
MID, EARLY, LATE, NOW = 1705276800000, 1704672000000, 1705881600000, 1706659200000
HALF_DAY = 43_200_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# logs

def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).cast("bigint")
    return state.from_changes(e, F.col("user_id"), ms, F.col("event_id"), F.col("event_type") == "error", ["event_type", "value", "props"])


def evx(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).withColumn("expires_at", F.col("ts") + HALF_DAY)


def vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    id_, none = F.col("vec_id").cast("string").alias("id"), F.lit(None).cast("bigint").alias("ts")
    first = e.select(id_, F.lit(False).alias("deleted"), none, F.lit(0).alias("ord"), "vector", "label")
    second = e.where("vec_id % 10 = 0").select(id_, F.lit(False).alias("deleted"), none, F.lit(1).alias("ord"), F.transform("vector", lambda x: -x).alias("vector"), "label")
    third = e.where("vec_id % 17 = 0").select(id_, F.lit(True).alias("deleted"), none, F.lit(2).alias("ord"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("int").alias("label"))
    return first.unionByName(second).unionByName(third)


def plain_vec(spark: SparkSession, d: str) -> DataFrame:
    return vec(spark, d).where("ord = 0")


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return state.from_changes(o, F.col("o_orderkey"), F.lit(None).cast("bigint"), F.col("o_orderkey"))


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


_EV = """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type = 'error' AS deleted, epoch_us(ts) // 1000 AS ts, event_id AS ord, event_type, value, props,
  epoch_us(ts) // 1000 + 43200000 AS expires_at FROM events)"""


def _state(at: int | None = None) -> str:
    cut = "" if at is None else f" WHERE ts IS NULL OR ts <= {at}"
    return (
        _EV + f""", st AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn, min(ord) OVER (PARTITION BY id) AS first_seen FROM ev{cut})
WHERE rn = 1 AND NOT deleted) """
    )


_VEC = """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) """
_VLOG = """WITH lg AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, false AS deleted, 0 AS ord, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings
  UNION ALL SELECT CAST(vec_id AS VARCHAR), false, 1, list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x), label FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL SELECT CAST(vec_id AS VARCHAR), true, 2, NULL, NULL FROM embeddings WHERE vec_id % 17 = 0),
v AS (SELECT id, vector, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM lg) WHERE rn = 1 AND NOT deleted),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) """
_COS, _DOT, _L2 = "round(list_cosine_similarity(vector, q), 6)", "round(list_inner_product(vector, q), 6)", "round(list_distance(vector, q), 6)"
_DOC = ("id", "event_type", "value", "props")


# scans, state, time travel

@_query(_EV + " SELECT id, deleted, ts, ord, event_type, value FROM ev")
def log_scan(spark, d):
    return ev(spark, d).select("id", "deleted", "ts", "ord", "event_type", "value")


@_query(_EV + f" SELECT id, deleted, ts, ord FROM ev WHERE ts <= {MID}")
def log_scan_asof(spark, d):
    return state.as_of(ev(spark, d), MID).select("id", "deleted", "ts", "ord")


@_query(_state() + "SELECT id, event_type, value, props FROM st")
def current_state(spark, d):
    return state.current_state(ev(spark, d)).select(*_DOC)


@_query(_state(MID) + "SELECT id, event_type, value, props FROM st")
def current_state_asof(spark, d):
    return state.current_state(ev(spark, d), at=MID).select(*_DOC)


@_query(_state() + "SELECT id, first_seen FROM st")
def first_seen_order(spark, d):
    return state.with_first_seen(ev(spark, d)).select("id", "first_seen")


# point reads

@_query(_state() + "SELECT id, event_type, value, props FROM st WHERE id = '7'")
def get_one(spark, d):
    return query.get(ev(spark, d), "7").select(*_DOC)


@_query(_EV + """, l AS (SELECT id, deleted, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM ev), e AS (SELECT min(id) FILTER (deleted) AS gone, min(id) FILTER (NOT deleted) AS live FROM l WHERE rn = 1)
SELECT gone AS deleted_id, live AS found FROM e""")
def get_deleted(spark, d):
    """Two reads at once, of an id that is deleted, though it has older versions, and of one that is live: only the latter is found."""
    log = ev(spark, d)
    last = state.latest(log).agg(F.min(F.when(F.col("deleted"), F.col("id"))).alias("gone"), F.min(F.when(~F.col("deleted"), F.col("id"))).alias("live")).first()
    both = query.get(log, last["gone"] or "").unionByName(query.get(log, last["live"] or ""))
    return both.select(F.lit(last["gone"]).alias("deleted_id"), F.col("id").alias("found"))


@_query(_state(MID) + "SELECT id, event_type, value, props FROM st WHERE id = '7'")
def get_asof(spark, d):
    return query.get(ev(spark, d), "7", at=MID).select(*_DOC)


@_query(_state() + "SELECT id, event_type, value, props FROM st WHERE id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000)")
def get_many(spark, d):
    ids = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string"))
    return query.get_many(ev(spark, d), ids).select(*_DOC)


@_query(_state() + "SELECT id, value FROM st WHERE id IN ('1', '2', '3', '5', '8', '13', '21', '34')")
def get_many_listed(spark, d):
    return query.get_many(ev(spark, d), ["1", "2", "3", "5", "8", "13", "21", "34", "1"]).select("id", "value")


# find

@_query(_state() + "SELECT id, event_type, value, props FROM st")
def find_all(spark, d):
    return query.find(ev(spark, d)).select(*_DOC)


@_query(_state() + "SELECT id, value FROM st WHERE event_type = 'click'")
def find_eq(spark, d):
    return query.find(ev(spark, d), {"event_type": "click"}).select("id", "value")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def find_eq_multi(spark, d):
    return query.find(orders(spark, d), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("id", "o_totalprice")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'number' AS asked FROM orders WHERE o_custkey = 7")
def find_no_coercion(spark, d):
    """A number never equals a text: asked for by both, only the number is found."""
    log = orders(spark, d)
    by_text, by_number = query.find(log, {"o_custkey": "7"}), query.find(log, {"o_custkey": 7})
    return by_text.select("id", F.lit("text").alias("asked")).unionByName(by_number.select("id", F.lit("number").alias("asked")))


@_query(_state() + "SELECT id, event_type, value FROM st WHERE value > 20 AND value <= 60 AND event_type <> 'view'")
def find_predicate(spark, d):
    return query.find(ev(spark, d), (F.col("value") > 20) & (F.col("value") <= 60) & (F.col("event_type") != "view")).select("id", "event_type", "value")


@_query(_state() + "SELECT id, event_type FROM st WHERE starts_with(id, '1')")
def find_prefix(spark, d):
    log = ev(spark, d)
    return query.find(log, parameters_column(log, {"prefix": "1"})).select("id", "event_type")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def find_typed_param(spark, d):
    log = orders(spark, d)
    return query.find(log, parameters_column(log, {"o_custkey": "7.0", "o_orderstatus": "O", "limit": "5"})).select("id", "o_custkey")


@_query(_state() + "SELECT id, event_type, value, props FROM (SELECT * FROM st ORDER BY first_seen LIMIT 10 OFFSET 5)")
def find_page(spark, d):
    return query.find(ev(spark, d), limit=10, offset=5).select(*_DOC)


@_query(_state(MID) + "SELECT id, event_type, value, props FROM (SELECT * FROM st WHERE event_type = 'view' ORDER BY first_seen LIMIT 7 OFFSET 2)")
def find_page_asof(spark, d):
    return query.find(ev(spark, d), {"event_type": "view"}, limit=7, offset=2, at=MID).select(*_DOC)


@_query(_state() + "SELECT CAST(20 AS INTEGER) AS page_limit, CAST(10 AS INTEGER) AS page_offset, (SELECT count(*) FROM st WHERE event_type = 'click') > 30 AS has_more")
def page_has_more(spark, d):
    return query.list_request(ev(spark, d), {"event_type": "click", "offset": "10"})[1]


@_query(_state() + "SELECT id, value FROM (SELECT * FROM st WHERE value > 50 ORDER BY first_seen LIMIT 20)")
def list_with_query(spark, d):
    """A request whose own query runs before the cut into pages."""
    return query.list_request(ev(spark, d), {"q": "value > 50"}, query=lambda docs, q: docs.where(q))[0].select("id", "value")


# counts

@_query(_state() + "SELECT count(*) AS n FROM st")
def count_live(spark, d):
    return state.count_live(ev(spark, d))


@_query(_state(MID) + "SELECT count(*) AS n FROM st")
def count_asof(spark, d):
    return state.count_live(ev(spark, d), at=MID)


@_query(_EV + f""", g AS (SELECT unnest([{EARLY}, {MID}, {LATE}]) AS as_of_ms), l AS (SELECT as_of_ms, deleted, row_number() OVER (PARTITION BY as_of_ms, id ORDER BY ord DESC) AS rn FROM ev JOIN g ON ev.ts <= g.as_of_ms)
SELECT as_of_ms, count(*) AS n FROM l WHERE rn = 1 AND NOT deleted GROUP BY as_of_ms""")
def count_timeline(spark, d):
    return state.count_timeline(ev(spark, d), [EARLY, MID, LATE])


# expiry

@_query(_state() + f"SELECT id, expires_at FROM st WHERE expires_at >= {NOW}")
def ttl_live(spark, d):
    return state.current_state(evx(spark, d), now=NOW, ttl="expires_at").select("id", "expires_at")


@_query(_state() + f"SELECT id, expires_at FROM st WHERE expires_at < {NOW}")
def ttl_expired(spark, d):
    return state.expired(evx(spark, d), NOW, "expires_at").select("id", "expires_at")


@_query(_state() + ", m AS (SELECT max(expires_at) AS x FROM st) SELECT id FROM st, m WHERE expires_at >= x")
def ttl_boundary(spark, d):
    """An expiry of exactly now is alive."""
    log = evx(spark, d)
    last = state.current_state(log).agg(F.max("expires_at")).first()[0]
    return state.current_state(log, now=last, ttl="expires_at").select("id")


@_query(_state() + f"SELECT id, true AS deleted, CAST({NOW} AS BIGINT) AS ts FROM st WHERE expires_at < {NOW}")
def delete_expired(spark, d):
    return state.expiry_tombstones(evx(spark, d), NOW, "expires_at", F.lit(1 << 40)).select("id", "deleted", "ts")


# maintenance

def _halves(spark, d):
    log = ev(spark, d)
    return log.where(F.col("ts") <= MID), log.where(F.col("ts") > MID)


@_query(_EV + f" SELECT count(*) FILTER (ts > {MID}) AS mutations_processed, count(*) AS versions FROM ev")
def compact_stats(spark, d):
    return maintenance.compaction_stats(*_halves(spark, d))


@_query(_state() + "SELECT id, ord, event_type FROM st")
def vacuum_survivors(spark, d):
    return maintenance.vacuumed(ev(spark, d)).select("id", "ord", "event_type")


@_query(_state() + "SELECT (SELECT count(*) FROM ev) AS scanned, (SELECT count(*) FROM st) AS kept, (SELECT count(*) FROM ev) - (SELECT count(*) FROM st) AS removed")
def vacuum_stats(spark, d):
    return maintenance.vacuum_stats(ev(spark, d))


# vectors

@_query(_VEC + f"SELECT id, {_DOT} AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
def vec_dot_topk(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, 10, "dotProduct").select("id", "score")


@_query(_VEC + f"SELECT id, {_COS} AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
def vec_cosine_topk(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, 10).select("id", "score")


@_query(_VEC + f"SELECT id, {_L2} AS score FROM v, q ORDER BY score, id LIMIT 10")
def vec_euclid_topk(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, 10, "euclidean").select("id", "score")


@_query(_VEC + f"SELECT id, {_COS} AS score FROM v, q WHERE {_COS} >= 0.2")
def vec_cos_threshold(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, None, "cosine", 0.2).select("id", "score")


@_query(_VEC + f"SELECT id, {_L2} AS score FROM v, q WHERE {_L2} <= 1.3")
def vec_euclid_threshold(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, None, "euclidean", 1.3).select("id", "score")


@_query(_VEC + f"SELECT id, {_COS} AS score FROM v, q WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def vec_filter_eq(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, 10, where={"label": 3}).select("id", "score")


@_query(_VEC + f"SELECT id, label, {_COS} AS score FROM v, q WHERE label % 2 = 1 AND label > 3 ORDER BY score DESC, id LIMIT 10")
def vec_filter_fn(spark, d):
    return search.search(plain_vec(spark, d), _first_vector(spark, d), 64, 10, where=lambda df: (df["label"] % 2 == 1) & (df["label"] > 3)).select("id", "label", "score")


@_query(_VLOG + f"SELECT id, {_COS} AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
def vec_search_updates(spark, d):
    return search.search(vec(spark, d), _first_vector(spark, d), 64, 10).select("id", "score")


@_query("""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vector, vec_id FROM embeddings),
r AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(b.vector, a.vector), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) SELECT query_id, id, score, rank FROM k WHERE rank <= 5""")
def vec_batch_search(spark, d):
    """The stated query set: every vector whose id is divisible by 50, against all."""
    docs = plain_vec(spark, d)
    asked = docs.where(F.col("id").cast("bigint") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return search.search_many(docs, asked, 64, 5)


@_query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vec_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude("embedding"), 6).alias("norm"))


@_query("""SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS square, round(n[1], 6) AS head FROM
(SELECT vec_id, list_transform(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 3 * x), lambda x: x / (3 * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))) AS n FROM embeddings)""")
def vec_normalize(spark, d):
    n = V.normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    e = table(spark, d, "embeddings").select("vec_id", n.alias("n"))
    return e.select("vec_id", F.round(V.dot("n", "n"), 6).alias("square"), F.round(F.col("n")[0], 6).alias("head"))


@_query("""SELECT a.vec_id AS vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_cosine_pair(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine("x", "y"), 6).alias("cosine"), F.round(V.euclidean("x", "y"), 6).alias("distance"))


@_query("SELECT id, ver, coalesce(len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64, false) AS valid FROM vector_documents")
def vec_validate(spark, d):
    return table(spark, d, "vector_documents").select("id", "ver", V.is_valid("vector", 64).alias("valid"))


@_query(_VLOG + "SELECT id, label FROM v WHERE label = 4")
def vec_find_no_vector(spark, d):
    return query.find(vec(spark, d), {"label": 4}, drop=("vector", "ts", "ord"))


# the store

def _store(spark: SparkSession):
    from ..operators.store import Store
    from ..runtime import scratch_path

    return Store(spark, scratch_path(spark, "store"))


def _customers(spark, d, name="customers"):
    s = _store(spark)
    c = s.collection(name)
    t = table(spark, d, "customer")
    c.put_df(t.select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey", "c_acctbal"))
    return s, c, t


def _named(c, at=None):
    doc = F.try_parse_json("data")
    return c.documents(at).select("id", F.try_variant_get(doc, "$.c_name", "string").alias("c_name"), F.try_variant_get(doc, "$.c_nationkey", "int").alias("c_nationkey"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey = 3 THEN 'moved' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 7 <> 0")
def store_changes(spark, d):
    """Bulk puts and deletions, a compaction between them and a vacuum after."""
    _, c, t = _customers(spark, d)
    c.compact()
    c.put_df(t.where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("id"), F.lit("moved").alias("c_name"), "c_nationkey"))
    c.delete_df(t.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string")))
    c.compact()
    c.vacuum()
    return _named(c)


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal FROM customer WHERE c_nationkey = 5")
def store_find(spark, d):
    _, c, _ = _customers(spark, d)
    doc = F.try_parse_json("data")
    return c.find({"c_nationkey": 5}).select("id", F.try_variant_get(doc, "$.c_acctbal", "double").alias("c_acctbal"))


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 1 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey = 1 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey <> 2")
def tx_commit(spark, d):
    s, c, _ = _customers(spark, d)
    s.transaction(lambda tx: (tx.put(c, {"id": "1", "c_name": "new", "c_nationkey": 0}), tx.delete(c, "2")))
    return _named(c)


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_nationkey FROM customer")
def tx_rollback(spark, d):
    from ..errors import TransactionError

    s, c, _ = _customers(spark, d)
    try:
        s.apply([{"type": "put", "collection": "customers", "id": "1", "data": {"c_name": "new"}}, {"type": "delete", "collection": "customers", "id": "2"}, {"type": "patch", "collection": "customers", "id": "3"}])
    except TransactionError:
        pass
    return _named(c)


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 1 THEN 'outer' ELSE c_name END AS c_name, CASE WHEN c_custkey = 1 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer")
def tx_nested(spark, d):
    """The inner transaction fails and is undone, the outer one stays."""
    from ..errors import TransactionError

    s, c, _ = _customers(spark, d)

    def inner(tx):
        tx.put(c, {"id": "2", "c_name": "inner", "c_nationkey": 0})
        raise ValueError

    def outer(tx):
        tx.put(c, {"id": "1", "c_name": "outer", "c_nationkey": 0})
        try:
            tx.transaction(inner)
        except TransactionError:
            pass

    s.transaction(outer)
    return _named(c)


@_query(_VLOG.replace("WITH lg", "WITH lg") + f"SELECT id, {_COS} AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
def store_vector_search(spark, d):
    """The vectors, their updates and deletions as three commits of a vector collection, then a search."""
    c = _store(spark).vector_collection("vectors", 64)
    log = vec(spark, d)
    for n in (0, 1):
        c.put_df(log.where(F.col("ord") == n).select("id", "vector", "label"))
    c.delete_df(log.where("ord = 2").select("id"))
    return c.search(_first_vector(spark, d), 10).select("id", "score")


_COMMITS = "(SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_nationkey = 3)"


@_query("SELECT collection FROM (VALUES ('a-1'), ('customers'), ('vectors')) t(collection)")
def catalog_list(spark, d):
    """The names of all collections of a store, whatever else lies in its folder."""
    s, _, _ = _customers(spark, d)
    s.vector_collection("vectors", 2)
    s.collection("a-1")
    spark.range(1).write.parquet(f"{s.root}/other")
    return spark.createDataFrame([(n,) for n in s.names()], "collection string")


@_query("SELECT 'customers' AS collection, (SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0) AS count, false AS sized, true AS sized_after, CAST(2 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS pending_after")
def collection_stats(spark, d):
    """Live documents and bytes of the base, before and after a compaction, and the pending commits."""
    s, c, t = _customers(spark, d)
    c.delete_df(t.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string")))
    before, pending = s.stats("customers"), c.count_pending()
    c.compact()
    after = s.stats("customers")
    assert before["count"] == after["count"]
    row = (after["collection"], after["count"], before["size"] > 0, after["size"] > 0, pending, c.count_pending())
    return spark.createDataFrame([row], "collection string, count bigint, sized boolean, sized_after boolean, pending bigint, pending_after bigint")


@_query("SELECT id, v FROM (VALUES ('a', 2), ('c', 1)) t(id, v)")
def put_batch_order(spark, d):
    """Twice the same id in one batch: the later place wins."""
    c = _store(spark).collection("batch")
    c.batch(lambda b: [b.put({"id": "a", "v": 1}), b.put({"id": "a", "v": 2}), b.put({"id": "b", "v": 1}), b.delete("b"), b.delete("c"), b.put({"id": "c", "v": 1})])
    return c.documents().select("id", F.try_variant_get(F.try_parse_json("data"), "$.v", "int").alias("v"))


@_query(f"SELECT {_COMMITS} AS mutations_processed, true AS bloom_filter_built, true AS index_built, {_COMMITS} AS versions, (SELECT count(*) FROM customer) AS n")
def compact_result(spark, d):
    """What a compaction of two commits reports, the versions it keeps and the documents they make."""
    _, c, t = _customers(spark, d)
    c.put_df(t.where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("id"), F.lit("moved").alias("c_name"), "c_nationkey"))
    r = c.compact()
    row = (r["mutations_processed"], r["bloom_filter_built"], r["index_built"], c.read().count(), c.count())
    return spark.createDataFrame([row], "mutations_processed bigint, bloom_filter_built boolean, index_built boolean, versions bigint, n bigint")


@_query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_nationkey, CAST(1 AS BIGINT) AS opened FROM customer")
def store_asof(spark, d):
    """The documents as of a time between two commits; only the first commit is opened."""
    from ..operators.store import monotonic_ms

    _, c, t = _customers(spark, d)
    between = monotonic_ms()
    c.put_df(t.select(F.col("c_custkey").cast("string").alias("id"), F.lit("later").alias("c_name"), F.lit(99).alias("c_nationkey")))
    folders = {f.rsplit("/", 2)[-2] for f in c.read(at=between).inputFiles()}
    return _named(c, at=between).withColumn("opened", F.lit(len(folders)).cast("bigint"))


@_query(_state() + f"SELECT (SELECT count(*) FROM st WHERE expires_at < {NOW}) AS removed, (SELECT count(*) FROM st WHERE expires_at >= {NOW}) AS left_over, CAST(0 AS BIGINT) AS again")
def store_delete_expired(spark, d):
    c = _store(spark).collection("events", ttl="expires_at")
    c.put_df(state.current_state(evx(spark, d)).select("id", "event_type", "expires_at"))
    removed = c.delete_expired(NOW)
    return spark.createDataFrame([(removed, c.count(now=0), c.delete_expired(NOW))], "removed bigint, left_over bigint, again bigint")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM (SELECT * FROM customer WHERE c_nationkey = 4 AND starts_with(CAST(c_custkey AS VARCHAR), '1'))
WHERE (SELECT count(*) FROM customer WHERE c_nationkey = 4 AND starts_with(CAST(c_custkey AS VARCHAR), '1')) <= 100""")
def request_list(spark, d):
    """A list request to a store, by prefix and the number of a nation given as text, in pages of at most 100; no rows where the last page
    doesn't say that nothing follows."""
    from ..operators.requests import Requests

    s, _, _ = _customers(spark, d)
    pages = Requests(s)
    page = pages.list("customers", {"prefix": "1", "c_nationkey": "4.0", "limit": "1000"})
    rows = [(x["id"], x["c_name"]) for x in page["data"]] if not page["pagination"]["has_more"] else []
    return spark.createDataFrame(rows, "id string, c_name string")


@_query("SELECT id, found, n FROM (VALUES ('1', true, 5), ('2', false, NULL), ('new', true, 1)) t(id, found, n)")
def request_documents(spark, d):
    """Put, delete and get by request."""
    from ..operators.requests import Requests

    s, _, _ = _customers(spark, d)
    r = Requests(s)
    r.put("customers", "1", {"id": "other", "n": 5})
    r.delete("customers", "2")
    r.transaction([{"type": "put", "collection": "customers", "id": "new", "data": {"n": 1}}])
    rows = []
    for i in ("1", "2", "new"):
        try:
            rows.append((i, True, r.get("customers", i)["n"]))
        except KeyError:
            rows.append((i, False, None))
    return spark.createDataFrame(rows, "id string, found boolean, n int")


@_query(_VEC + f"SELECT id, {_COS} AS score FROM v, q ORDER BY score DESC, id LIMIT 100")
def vec_request(spark, d):
    """A search request that asks for more than it gets: at most 100."""
    from ..operators.requests import Requests

    s = _store(spark)
    s.vector_collection("vectors", 64).put_df(plain_vec(spark, d).select("id", "vector", "label"))
    found = Requests(s).search("vectors", {"vector": _first_vector(spark, d), "k": 5000, "metric": "cosine"})
    return spark.createDataFrame([(x["id"], x["score"]) for x in found], "id string, score double")


# log files of JSON text

def _legacy(spark, d):
    """EV as a main file of lines, and two pending files."""
    from ..runtime import Hdfs, scratch_path

    folder = scratch_path(spark, "legacy")
    log = ev(spark, d).coalesce(1).sortWithinPartitions("ord")  # a main file is one file
    data = F.when(F.col("deleted"), "null").otherwise(F.to_json(F.struct("event_type", "value")))
    log.select(F.concat(F.lit('["'), "id", F.lit('",'), data, F.lit(","), "ts", F.lit("]"))).write.text(f"{folder}/ev.jsonl")
    fs = Hdfs(spark, folder)
    fs.create(f"{folder}/ev.mutation.{LATE}-a", f'[["1",{{"event_type":"new"}},{LATE - 1}],["2",null,{LATE - 1}],"odd"]')
    fs.create(f"{folder}/ev.mutation.{NOW}-b", f'[["2",{{"event_type":"again"}},{NOW - 1}],["only",{{"event_type":"new"}},{NOW - 1}]]')
    fs.create(f"{folder}/ev.mutation.{NOW + 1}-c", "[[broken")
    return folder


_LEGACY = _EV + f""", lg AS (SELECT id, deleted, ts, 0 AS src, ord, CASE WHEN NOT deleted THEN event_type END AS event_type FROM ev
UNION ALL SELECT * FROM (VALUES ('1', false, {LATE - 1}, 1, 0, 'new'), ('2', true, {LATE - 1}, 1, 1, NULL), ('2', false, {NOW - 1}, 1, 2, 'again'), ('only', false, {NOW - 1}, 1, 3, 'new')) t)"""


@_query(_LEGACY + " SELECT id, deleted, ts, event_type FROM lg")
def legacy_scan(spark, d):
    from ..sources import legacy

    return legacy.read_log(spark, _legacy(spark, d), "ev").select("id", "deleted", "ts", F.try_variant_get("data", "$.event_type", "string").alias("event_type"))


@_query(_LEGACY + " SELECT id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC, ord DESC) AS rn FROM lg) WHERE rn = 1 AND NOT deleted")
def legacy_state(spark, d):
    from ..sources import legacy

    return state.current_state(legacy.read_log(spark, _legacy(spark, d), "ev")).select("id", F.try_variant_get("data", "$.event_type", "string").alias("event_type"))


@_query(_LEGACY + f" SELECT id, event_type, CAST(1 AS BIGINT) AS pending_opened FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src DESC, ord DESC) AS rn FROM lg WHERE ts <= {LATE}) WHERE rn = 1 AND NOT deleted")
def legacy_asof(spark, d):
    """As of a time; pending files named long after it aren't opened."""
    from ..sources import legacy

    log = legacy.read_log(spark, _legacy(spark, d), "ev", at=LATE)
    opened = sum(".mutation." in f for f in log.inputFiles())
    return state.current_state(log, at=LATE).select("id", F.try_variant_get("data", "$.event_type", "string").alias("event_type"), F.lit(opened).cast("bigint").alias("pending_opened"))
