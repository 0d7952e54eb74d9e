"""Records held in the bodies of a document log's storage objects (pending batches and main files)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of objects that hold records, `<volume>/<collection>.<rest>`.
OBJECT_KEY = r"^([^/]*)/([^./]*)\.(.*)$"
MAIN_FILE = r"\.jsonl$"
PENDING_FILE = r"\.mutation\.[0-9]+-[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

RECORD_SCHEMA = (
    "object_key string, pos bigint, volume string, collection string, id string, data string, ts string, "
    "print binary"
)
_ARROW = pa.schema(
    [
        ("object_key", pa.string()),
        ("pos", pa.int64()),
        ("volume", pa.string()),
        ("collection", pa.string()),
        ("id", pa.string()),
        ("data", pa.string()),
        ("ts", pa.string()),
        ("print", pa.binary()),
    ]
)
#: Records of one output batch; keeps a task's memory bounded however long a body is.
_BATCH = 4096


def _no_constant(_: str):
    raise ValueError("NaN and Infinity aren't JSON")


def _number(text: str):
    x = float(text)
    return int(x) if x.is_integer() else x


_decode = json.JSONDecoder(parse_float=_number, parse_constant=_no_constant).decode
_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def canonical(value) -> str:
    """JSON text that is equal for equal JSON values: sorted object keys, no blanks, 1.0 written as 1."""
    text = _encode(value)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair, which JSON allows and UTF-8 doesn't
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return text


def parse(text: str):
    """The JSON value, or an exception of ValueError's or RecursionError's kind."""
    return _decode(text)


def records_of(key: str, body: str) -> Iterator[tuple[int, str, str, str | None]]:
    """(pos, id, data, ts) of each record in one body, as canonical JSON texts; ts is None where it's missing or null."""
    pending = re.search(PENDING_FILE, key) is not None
    if pending:
        try:
            items = parse(body)
        except (ValueError, RecursionError):
            return
        numbered = enumerate(items) if isinstance(items, list) else iter(())
    else:
        numbered = enumerate(body.split("\n"))
    for pos, item in numbered:
        if not pending:
            try:
                item = parse(item)
            except (ValueError, RecursionError):
                continue
        if not isinstance(item, list) or len(item) < 2:
            continue
        try:
            yield pos, canonical(item[0]), canonical(item[1]), None if len(item) < 3 or item[2] is None else canonical(item[2])
        except RecursionError:
            continue


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    name = re.compile(OBJECT_KEY, re.S)
    rows: list[tuple] = []
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            volume, collection, _ = name.match(key).groups()
            for pos, rid, data, ts in records_of(key, body):
                mark = xxhash.xxh3_128_digest("\x00".join((volume, collection, rid, data, "" if ts is None else ts)).encode())
                rows.append((key, pos, volume, collection, rid, data, ts, mark))
                if len(rows) >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def object_records(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per stored record of the objects that are named in ``pages.keys`` and hold records.

    Columns are RECORD_SCHEMA: ``pos`` is the place in the array or the line, from 0; ``id``, ``data`` and ``ts`` are JSON
    texts that are equal for equal values; ``print`` is a 128-bit hash of (volume, collection, id, data, ts), by which equal
    records are recognised. Bodies and lines that aren't valid JSON, blank lines and items that are no array of two or more
    hold no record, but a line keeps its number. Null keys and bodies hold nothing. A key named many times counts once.
    """
    key = F.col("object_key")
    holds = key.rlike(OBJECT_KEY) & (key.rlike(MAIN_FILE) | key.rlike(PENDING_FILE))
    named = pages.select(F.explode("keys").alias("object_key")).where(holds).distinct()
    bodies = objects.where(holds & F.col("body").isNotNull()).select("object_key", "body")
    return bodies.join(named, "object_key", "left_semi").mapInArrow(_parse_batches, RECORD_SCHEMA)
