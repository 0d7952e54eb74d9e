import itertools
import json
import random

import pytest

from logstrata.operators import changefeed
from logstrata.operators.changefeed import current_fields, current_positions

SCHEMA = "commit_no bigint, op_index int, type string, collection string, id string, data string"


def brute(ops):
    refused = {o[0] for o in ops if o[0] is not None and o[1] is not None and (o[2] not in ("put", "delete") or (o[2] == "put" and (o[5] is None or o[5].strip() == "null")))}
    docs = {}
    for o in sorted({(o[0], o[1]): o for o in ops if o[0] is not None and o[1] is not None}.values(), key=lambda o: o[:2]):
        if o[0] in refused or o[3] is None or o[4] is None:
            continue
        docs[o[3], o[4]] = (o[0], o[1]) if o[2] == "put" else None
    return sorted((*k, *v) for k, v in docs.items() if v)


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 12), (3, 1)])
def test_any_order_of_delivery(spark, rows, monkeypatch, seed, hot):
    monkeypatch.setattr(changefeed, "HOT", hot)
    r = random.Random(seed)
    ops = [(c, i, r.choice(["put"] * 6 + ["delete"] * 3 + ["Put", None][: r.randint(0, 2) // 2]), r.choice("AB"), f"d{r.randint(0, 9)}", r.choice(['{"a":1}'] * 30 + [" null ", None])) for c in range(60) for i in range(r.randint(1, 3))]
    ops += r.choices(ops, k=40)
    r.shuffle(ops)
    assert rows(current_positions(spark.createDataFrame(ops, SCHEMA))) == brute(ops)


def test_nulls_empty_and_clashing_names(spark, rows):
    assert current_positions(spark.createDataFrame([], SCHEMA)).count() == 0
    ops = [(None, 0, "put", "A", "x", "{}"), (1, None, "put", "A", "x", "{}"), (2, 0, "put", None, "x", "{}"), (2, 1, "put", "A", None, "{}"), (2, 2, "put", "A", "y", "{}"), (-5, 0, "put", "A", "z", "{}"), (3, 0, "put", None, "x", None), (3, 1, "put", "A", "w", "{}")]
    df = spark.createDataFrame(ops, SCHEMA)
    for name in ("seq", "refused", "is_delete", "last_seq", "field", "value"):
        df = df.selectExpr("*", f"1 AS {name}")
    assert rows(current_positions(df)) == [("A", "y", 2, 2), ("A", "z", -5, 0)]
    assert rows(current_fields(df)) == [("A", "y", None, None), ("A", "z", None, None)]


def test_fields_of_puts_and_merges(spark, rows):
    ops = [
        (1, 0, "put", "A", "x", '{"a":1,"b":2}'), (2, 0, "patch", "A", "x", '{"b":3,"c":{"k":[1]}}'), (3, 0, "patch", "A", "x", '{"a":null}'),
        (1, 1, "put", "A", "y", '{"a":1}'), (2, 1, "delete", "A", "y", None), (3, 1, "patch", "A", "y", '{"z":"s"}'), (4, 0, "patch", "A", "n", '{"q":true}'),
        (5, 0, "put", "A", "r", '{"a":1}'), (6, 0, "put", "A", "r", "[1]"),
    ]
    for order in itertools.islice(itertools.permutations(ops), 0, 40000, 13337):
        got = rows(current_fields(spark.createDataFrame(list(order), SCHEMA), merge=("patch",)))
        assert got == sorted([("A", "n", "q", "true"), ("A", "r", None, None), ("A", "x", "a", "null"), ("A", "x", "b", "3"), ("A", "x", "c", json.dumps({"k": [1]}, separators=(",", ":"))), ("A", "y", "z", '"s"')], key=repr)
    assert rows(current_fields(spark.createDataFrame(ops, SCHEMA)).select("id").distinct()) == [("r",), ("x",), ("y",)]  # patch isn't known: its transactions are undone
