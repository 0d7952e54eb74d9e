"""The queries of the core operators and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import changefeed, compaction
from ..runtime import scratch_path
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.left_out_copies(table(spark, d, "storage_objects"), table(spark, d, "list_pages"), scratch_path(spark, "compacted"))


def p1_compaction(spark: SparkSession, d: str) -> DataFrame:
    report = compaction.compact_small_files(table(spark, d, "storage_objects"), table(spark, d, "list_pages"), scratch_path(spark, "compacted"))
    return spark.createDataFrame([report.__dict__])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_positions(table(spark, d, "tx_operations"))


def p3_fields(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_fields(table(spark, d, "tx_operations"))


def p3_merged_fields(spark: SparkSession, d: str) -> DataFrame:
    """The same feed read with puts that only set the fields they hold, since the last delete."""
    return changefeed.current_fields(table(spark, d, "tx_operations"), replace=(), merge=("put",))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_compaction, p3_found, p3_fields, p3_merged_fields)}

# Fields as the engine writes them: whole numbers without .0, keys of an object within a field in order.
_FLAT = r"""
inner_fields AS (
  SELECT flat.collection, flat.id, flat.field, '{' || string_agg('"' || g.key || '":' || regexp_replace(CAST(g.value AS VARCHAR), '^(-?[0-9]+)\.0$', '\1'), ',' ORDER BY g.key) || '}' AS value
  FROM flat, json_each(flat.value) g WHERE flat.type = 'OBJECT' GROUP BY flat.collection, flat.id, flat.field
)
SELECT collection, id, field, CASE WHEN type = 'DOUBLE' THEN regexp_replace(CAST(value AS VARCHAR), '^(-?[0-9]+)\.0$', '\1') ELSE CAST(value AS VARCHAR) END AS value FROM flat WHERE type <> 'OBJECT'
UNION ALL SELECT collection, id, field, value FROM inner_fields
"""
_UNDONE = """
WITH undone AS (
  SELECT DISTINCT commit_no FROM tx_operations
  WHERE type IS NULL OR type NOT IN ('put', 'delete') OR (type = 'put' AND (data IS NULL OR trim(data) = 'null'))
),
"""

SQL: dict[str, str] = {
    # data is compared by the leaves of its JSON tree in order of their paths, numbers as doubles
    "p1_found": r"""
WITH listed AS (SELECT DISTINCT unnest(keys) AS object_key FROM list_pages),
bodies AS (
  SELECT object_key, body, regexp_matches(object_key, '\.mutation\.[0-9]+-[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS pending
  FROM storage_objects JOIN listed USING (object_key) WHERE body IS NOT NULL
),
items AS (
  SELECT object_key, unnest(range(CAST(json_array_length(body) AS BIGINT))) AS pos, unnest(json_extract(body, '$[*]')) AS item
  FROM bodies WHERE pending AND json_valid(body) AND json_type(body) = 'ARRAY'
  UNION ALL
  SELECT object_key, pos, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS item
  FROM (SELECT object_key, unnest(range(len(string_split(body, chr(10))))) AS pos, unnest(string_split(body, chr(10))) AS line FROM bodies WHERE NOT pending AND regexp_matches(object_key, '\.jsonl$'))
),
records AS (
  SELECT object_key, pos, regexp_extract(object_key, '^([^/]*)/', 1) AS volume, regexp_extract(object_key, '^[^/]*/([^./]*)\.', 1) AS collection,
    item->'$[0]' AS id, item->'$[1]' AS data, CASE WHEN json_type(item->'$[2]') <> 'NULL' THEN item->'$[2]' END AS ts
  FROM items WHERE json_type(item) = 'ARRAY' AND json_array_length(item) >= 2
),
leaves AS (
  SELECT r.object_key, r.pos, r.volume, r.collection, r.id, r.ts, string_agg(t.fullkey || ' ' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number ' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR)
      ELSE t.type || ' ' || coalesce(CAST(t.atom AS VARCHAR), '') END, chr(10) ORDER BY t.fullkey) AS data
  FROM records r, json_tree(r.data) t GROUP BY ALL
),
ranked AS (
  SELECT object_key, pos, row_number() OVER (PARTITION BY volume, collection, CAST(id AS VARCHAR), coalesce(CAST(CAST(ts AS DOUBLE) AS VARCHAR), ''), data ORDER BY object_key, pos) AS n FROM leaves
)
SELECT object_key, pos FROM ranked WHERE n > 1
""",
    "p3_found": """
WITH undone AS (
  SELECT DISTINCT commit_no FROM tx_operations
  WHERE type IS NULL OR type NOT IN ('put', 'delete') OR (type = 'put' AND (data IS NULL OR trim(data) = 'null'))
),
last AS (
  SELECT collection, id, commit_no, op_index, type, row_number() OVER (PARTITION BY collection, id ORDER BY commit_no DESC, op_index DESC) AS r
  FROM tx_operations WHERE commit_no NOT IN (SELECT commit_no FROM undone)
)
SELECT collection, id, commit_no, op_index FROM last WHERE r = 1 AND type = 'put'
""",
    "p3_fields": _UNDONE
    + """
last AS (
  SELECT collection, id, type, data, row_number() OVER (PARTITION BY collection, id ORDER BY commit_no DESC, op_index DESC, data DESC NULLS LAST) AS r
  FROM tx_operations WHERE commit_no NOT IN (SELECT commit_no FROM undone)
),
docs AS (SELECT collection, id, CAST(data AS JSON) AS data FROM last WHERE r = 1 AND type = 'put'),
flat AS (SELECT d.collection, d.id, f.key AS field, f.type, f.value FROM docs d, json_each(d.data) f),
"""
    + _FLAT
    + "UNION ALL SELECT collection, id, NULL, NULL FROM docs WHERE json_type(data) <> 'OBJECT' OR len(json_keys(data)) = 0",
    "p3_merged_fields": _UNDONE
    + """
ops AS (
  SELECT collection, id, type, CAST(commit_no AS HUGEINT) * 4294967296 + op_index AS seq, max(data) AS data
  FROM tx_operations WHERE commit_no NOT IN (SELECT commit_no FROM undone) GROUP BY ALL
),
gone AS (SELECT collection, id, max(seq) AS seq FROM ops WHERE type = 'delete' GROUP BY ALL),
puts AS (
  SELECT o.collection, o.id, o.seq, CAST(o.data AS JSON) AS data FROM ops o LEFT JOIN gone g ON g.collection = o.collection AND g.id = o.id
  WHERE o.type = 'put' AND (g.seq IS NULL OR o.seq > g.seq)
),
every AS (SELECT p.collection, p.id, f.key AS field, f.type, f.value, row_number() OVER (PARTITION BY p.collection, p.id, f.key ORDER BY p.seq DESC) AS r FROM puts p, json_each(p.data) f),
flat AS (SELECT collection, id, field, type, value FROM every WHERE r = 1),
"""
    + _FLAT
    + "UNION ALL SELECT collection, id, NULL, NULL FROM puts GROUP BY collection, id HAVING max(len(json_keys(data))) = 0",
}

from . import catalogue  # noqa: E402

QUERIES.update(catalogue.QUERIES)
SQL.update(catalogue.SQL)
