"""Reading documents from a log: by id, by many ids, by predicate, in pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Where, parameters_column, where_column
from .state import current_state, with_first_seen

#: Ids that a multi-read puts into the scan's filter; more are joined.
LISTED_IDS = 1000
# Page sizes of a list request.
PAGE, MOST_PAGE = 20, 100


def get(log: DataFrame, id: str, at: int | None = None, now: int | None = None, ttl: str | None = None) -> DataFrame:
    """The document of ``id``: one row or none. The filter on the id reaches the scan."""
    return current_state(log.where(F.col("id") == id), at, now, ttl)


def get_many(log: DataFrame, ids: list[str] | DataFrame, at: int | None = None, now: int | None = None, ttl: str | None = None) -> DataFrame:
    """The documents of a set of ids; absent ones are left out, repeated ids count once.

    A frame of ids (its first column), or a long list, is a semi-join below the latest-per-id step, so that only their versions
    are shuffled; the planner broadcasts it if it's small.
    """
    if isinstance(ids, list):
        if len(ids) <= LISTED_IDS:
            return current_state(log.where(F.col("id").isin(ids)), at, now, ttl)
        ids = log.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("id"))
    return current_state(log.join(wanted, "id", "left_semi"), at, now, ttl)


def find(log: DataFrame, where: Where = None, limit: int | None = None, offset: int = 0, at: int | None = None, now: int | None = None,
         ttl: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Live documents that fulfil ``where``, see `where_column`; the predicate is applied to the latest versions only.

    With ``limit`` or ``offset`` the documents are in order of first appearance and ``first_seen`` is dropped again. None is no
    limit, 0 no rows; negative values and fractions are refused.
    """
    for n in (limit, offset):
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
            raise ValueError("limit and offset are whole numbers from 0")
    if limit is None and not offset:
        docs = current_state(log, at, now, ttl)
        return docs.where(where_column(docs, where)).drop("deleted", *drop)
    docs = with_first_seen(log, at, now, ttl)
    docs = docs.where(where_column(docs, where)).drop("deleted", *drop).orderBy("first_seen", "id")
    if offset:
        docs = docs.offset(offset)
    if limit is not None:
        docs = docs.limit(limit)
    return docs.drop("first_seen")


def page_bounds(parameters: dict[str, str]) -> tuple[int, int]:
    """(limit, offset) of a request: ``limit`` is 20 by default and kept within 1 and 100, ``offset`` 0; texts that are no numbers
    count as absent."""

    def number(name: str, default: int) -> int:
        try:
            return int(parameters.get(name, default))
        except ValueError:
            return default

    return min(MOST_PAGE, max(1, number("limit", PAGE))), max(0, number("offset", 0))


def list_request(log: DataFrame, parameters: dict[str, str], query: Callable[[DataFrame, str], DataFrame] | None = None, at: int | None = None,
                 now: int | None = None, ttl: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page for request parameters, and one row ``(page_limit, page_offset, has_more)``.

    ``limit`` and ``offset`` as in `page_bounds`. ``query`` with the parameter ``query`` or ``q`` changes the filtered documents
    before they are cut into pages.
    """
    limit, offset = page_bounds(parameters)
    docs = with_first_seen(log, at, now, ttl)
    docs = docs.where(parameters_column(docs, parameters)).drop("deleted")
    asked = parameters.get("query") or parameters.get("q")
    if query is not None and asked:
        docs = query(docs, asked)
    ordered = docs.orderBy("first_seen", "id").offset(offset).limit(limit + 1)
    page = ordered.limit(limit).drop("first_seen")
    more = ordered.agg((F.count(F.lit(1)) > limit).alias("has_more")).select(
        F.lit(limit).alias("page_limit"), F.lit(offset).alias("page_offset"), "has_more"
    )
    return page, more
