"""Document predicates compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Request parameters that page or search and never filter.
RESERVED = ("limit", "offset", "prefix", "query", "q")
_NUMERIC_TEXT = re.compile(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$")

Where = Column | str | Mapping | Callable[[DataFrame], Column] | None


def _numeric(kind: str) -> bool:
    return kind in _NUMBERS or kind.startswith("decimal")


def strict_equals(name: str, kind: str, value) -> Column:
    """Equality without coercion: a value of another type class never matches, null matches only null, arrays and objects never."""
    c = F.col(f"`{name}`")
    if value is None:
        return c.isNull()
    if isinstance(value, bool):
        same = kind == "boolean"
    elif isinstance(value, int | float):
        same = _numeric(kind)
    else:
        same = isinstance(value, str) and kind == "string"
    return (c == F.lit(value)) if same else F.lit(False)


def where_column(df: DataFrame, where: Where) -> Column:
    """A predicate over ``df`` from a column, an SQL text, a function of the frame, or a mapping whose entries all have to hold.

    A column that the frame lacks matches null only, as the field is missing in every document.
    """
    if where is None:
        return F.lit(True)
    if isinstance(where, Column):
        return where
    if isinstance(where, str):
        return F.expr(where)
    if isinstance(where, Mapping):
        kinds = dict(df.dtypes)
        out = F.lit(True)
        for k, v in where.items():
            out = out & (strict_equals(k, kinds[k], v) if k in kinds else F.lit(v is None))
        return out
    return where(df)


def strict_equals_variant(doc: Column, name: str, value) -> Column:
    """As `strict_equals`, over a VARIANT document: the field's own type decides, and a missing field matches nothing."""
    path = "$['" + name.replace("'", "\\'") + "']"
    field = F.try_variant_get(doc, path, "variant")
    kind = F.schema_of_variant(field)
    if value is None:
        return F.coalesce(F.is_variant_null(field), F.lit(False))
    if isinstance(value, bool):
        same, got = kind == "BOOLEAN", F.try_variant_get(doc, path, "boolean")
    elif isinstance(value, int | float):
        same = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        got, value = F.try_variant_get(doc, path, "double"), float(value)
    elif isinstance(value, str):
        same, got = kind == "STRING", F.try_variant_get(doc, path, "string")
    else:
        return F.lit(False)
    return F.coalesce(same & (got == F.lit(value)), F.lit(False))


def parameter_equals(name: str, kind: str, text: str) -> Column:
    """Loose equality with a request parameter: true/false only match booleans, numeric texts match numbers by value, all else
    the text of the field. Null matches nothing."""
    c = F.col(f"`{name}`")
    if text in ("true", "false"):
        out = (c == F.lit(text == "true")) if kind == "boolean" else F.lit(False)
    elif _NUMERIC_TEXT.match(text) and _numeric(kind):
        out = c.cast("double") == F.lit(float(text))
    else:
        out = c.cast("string") == F.lit(text)
    return F.coalesce(out, F.lit(False))


def parameters_column(df: DataFrame, parameters: Mapping[str, str], id_column: str = "id") -> Column:
    """All filters of a request: ``prefix`` on the id, and equality for every parameter that isn't reserved."""
    kinds = dict(df.dtypes)
    out = F.lit(True)
    if parameters.get("prefix"):
        out = out & F.col(id_column).startswith(parameters["prefix"])
    for k, v in parameters.items():
        if k not in RESERVED:
            out = out & (parameter_equals(k, kinds[k], v) if k in kinds else F.lit(False))
    return out


def parameters_variant(docs: DataFrame, parameters: Mapping[str, str], doc: str = "doc", id_column: str = "id") -> Column:
    """As `parameters_column`, over a VARIANT document: the type of the field in each document decides."""
    out = F.lit(True)
    if parameters.get("prefix"):
        out = out & F.col(id_column).startswith(parameters["prefix"])
    for name, text in parameters.items():
        if name in RESERVED:
            continue
        path = "$['" + name.replace("'", "\\'") + "']"
        field = F.try_variant_get(F.col(doc), path, "variant")
        kind = F.schema_of_variant(field)
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        as_text = F.try_variant_get(F.col(doc), path, "string")
        if text in ("true", "false"):
            same = (kind == "BOOLEAN") & (F.try_variant_get(F.col(doc), path, "boolean") == F.lit(text == "true"))
        elif _NUMERIC_TEXT.match(text):
            same = F.when(number, F.try_variant_get(F.col(doc), path, "double") == F.lit(float(text))).otherwise(as_text == F.lit(text))
        else:
            same = as_text == F.lit(text)
        out = out & F.coalesce(same, F.lit(False))
    return out
