"""Rebuilding documents from a change feed: column-wise last writer wins, in SQL only.

Input is a feed of operations ``(commit_no, op_index, type, collection, id, data)`` delivered in any order and any number
of times. The order of operations is (commit_no, op_index); deliveries that agree in both are one operation.

Plan: the refused transactions are found with one aggregation (few rows, so the anti-join is broadcast at run time if it is
small, else sorted). Then every document keeps its latest delete or replacement and its last write, maxima of one decimal that
holds both parts of the order, so that aggregation combines on the map side: a document with a tenth of all rows costs one row per
task in the shuffle. Only writes from there on are opened, and each of their fields is taken with max_by. Where the writes meet
their documents, those with a thousandth of all operations or more, a thousand at most, are broadcast and their writes stay where
they are; the others are joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..runtime import materialize

#: A document is hot if it has one of so many parts of all operations; as many can be hot at most.
HOT = 1000
#: (commit_no, op_index) as one decimal. op_index is a 32-bit integer and is moved to be non-negative.
_SEQ = "CAST(commit_no AS DECIMAL(20,0)) * 4294967296 + (CAST(op_index AS BIGINT) + 2147483648)"


def _quoted(types: tuple[str, ...]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in types) or "NULL"


def _accepted(feed: DataFrame, replace: tuple[str, ...], merge: tuple[str, ...], delete: tuple[str, ...], with_data: bool) -> DataFrame:
    writes = _quoted(replace + merge)
    known = _quoted(replace + merge + delete)
    return feed.sparkSession.sql(
        f"""
        WITH ops AS (
          SELECT collection, id, commit_no, {_SEQ} AS seq,
                 type IN ({_quoted(delete)}) AS is_delete,
                 type IN ({_quoted(replace)}) AS is_replace,
                 (type IS NULL OR type NOT IN ({known})
                  OR (type IN ({writes}) AND (data IS NULL OR trim(BOTH ' \t\n\r' FROM data) = 'null'))) AS refused
                 {", data" if with_data else ""}
          FROM {{feed}}
          WHERE commit_no IS NOT NULL AND op_index IS NOT NULL
        ),
        undone AS (SELECT commit_no FROM ops WHERE refused GROUP BY commit_no)
        SELECT ops.* EXCEPT (commit_no, refused)
        FROM ops LEFT ANTI JOIN undone ON ops.commit_no = undone.commit_no
        WHERE collection IS NOT NULL AND id IS NOT NULL
        """,
        feed=feed,
    )


def _heads(accepted: DataFrame) -> DataFrame:
    """``(collection, id, first_seq, last_seq, times)`` of the documents that exist, written."""
    return materialize(
        accepted.sparkSession.sql(
            """
            SELECT collection, id, first_seq, last_seq, times FROM (
              SELECT collection, id, count(*) AS times,
                     max(CASE WHEN NOT is_delete THEN seq END) AS last_seq,
                     max(CASE WHEN is_delete THEN seq END) AS deleted_seq,
                     max(CASE WHEN is_delete OR is_replace THEN seq END) AS first_seq
              FROM {ops} GROUP BY collection, id)
            WHERE last_seq IS NOT NULL AND (deleted_seq IS NULL OR last_seq > deleted_seq)
            """,
            ops=accepted,
        ),
        "heads",
    )


def _latest_fields(feed: DataFrame, replace: tuple[str, ...], merge: tuple[str, ...], delete: tuple[str, ...]) -> DataFrame:
    """``(collection, id, last_seq, field, value, seq)``: the fields of every current document with the operation that set each."""
    accepted = _accepted(feed, replace, merge, delete, True)
    heads = _heads(accepted)
    least = heads.sparkSession.sql("SELECT coalesce(sum(times), 0) AS n FROM {heads}", heads=heads).first()[0] / HOT
    return feed.sparkSession.sql(
        """
        WITH heads AS (SELECT * FROM {heads}),
        hot AS (SELECT collection, id, coalesce(first_seq, -1e37) AS from_seq FROM heads WHERE times >= {least}),
        met AS (
          SELECT /*+ BROADCAST(hot) */ o.collection, o.id, o.seq, o.data, hot.from_seq
          FROM {ops} o LEFT JOIN hot ON o.collection = hot.collection AND o.id = hot.id WHERE NOT o.is_delete
        ),
        writes AS (
          SELECT collection, id, seq, max(data) AS data FROM (
            SELECT collection, id, seq, data FROM met WHERE seq >= from_seq
            UNION ALL
            SELECT m.collection, m.id, m.seq, m.data FROM met m JOIN heads h ON m.collection = h.collection AND m.id = h.id
            WHERE m.from_seq IS NULL AND h.times < {least} AND (h.first_seq IS NULL OR m.seq >= h.first_seq))
          GROUP BY collection, id, seq
        ),
        fields AS (
          SELECT w.collection, w.id, w.seq, f.key AS field, to_json(f.value) AS value
          FROM writes w, LATERAL variant_explode(
            CASE WHEN schema_of_variant(try_parse_json(w.data)) LIKE 'OBJECT%' THEN try_parse_json(w.data) END) f
        ),
        latest AS (
          SELECT collection, id, field, max_by(coalesce(value, 'null'), seq) AS value, max(seq) AS seq
          FROM fields GROUP BY collection, id, field
        )
        SELECT h.collection, h.id, h.last_seq, l.field, l.value, l.seq
        FROM heads h LEFT JOIN latest l ON h.collection = l.collection AND h.id = l.id
        """,
        heads=heads,
        ops=accepted,
        least=least,
    )


def current_positions(feed: DataFrame, replace: tuple[str, ...] = ("put",), merge: tuple[str, ...] = (), delete: tuple[str, ...] = ("delete",)) -> DataFrame:
    """One row ``(collection, id, commit_no, op_index)`` for each document that exists, with the operation that wrote its state.

    That is the last one that set any of its current fields, or the last write where it has none. A transaction (all rows of a
    commit_no) holding an operation of any other type, or a write whose data is null or JSON null, is undone as a whole. Rows
    without commit_no or op_index can't be ordered and count as not delivered; rows without collection or id name no document,
    but still undo their transaction if refused. Repeated rows change nothing, an empty feed gives no rows, and further columns
    of any name are ignored.
    """
    return feed.sparkSession.sql(
        """
        SELECT collection, id, CAST(floor(seq / 4294967296) AS BIGINT) AS commit_no,
               CAST(seq - floor(seq / 4294967296) * 4294967296 - 2147483648 AS INT) AS op_index
        FROM (SELECT collection, id, coalesce(max(seq), max(last_seq)) AS seq FROM {fields} GROUP BY collection, id)
        """,
        fields=_latest_fields(feed, replace, merge, delete),
    )


def current_fields(feed: DataFrame, replace: tuple[str, ...] = ("put",), merge: tuple[str, ...] = (), delete: tuple[str, ...] = ("delete",)) -> DataFrame:
    """The top-level fields of every current document: ``(collection, id, field, value)``, value as JSON text.

    For each field the value is taken with max_by over the operations that set it, from the latest delete or replacement of
    the document on. Types in ``merge`` set only the fields they hold. A document without fields (``{}``, or data that is no
    JSON object) has one row with field and value null. Nulls, repeats and undone transactions as in `current_positions`.
    Of deliveries of one operation that are written differently the largest text is taken, so the result is the same in any
    order of delivery.
    """
    return _latest_fields(feed, replace, merge, delete).select("collection", "id", "field", "value")
