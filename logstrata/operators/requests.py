"""What a service in front of a store asks for: documents by request, searches, transactions given as data, and upkeep.

Answers are plain values; pages and searches are bounded by the limits of `query` and `search`, so an answer never grows with the
collection. What goes wrong is raised as one of `errors`, or as KeyError for what isn't there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import parameters_variant
from .query import page_bounds
from .store import Collection, Store


class Requests:
    def __init__(self, store: Store, query: Callable[[DataFrame, str], DataFrame] | None = None):
        """``query`` changes the filtered documents of a list request by its parameter ``query`` or ``q``, before they are paged."""
        self.store, self.query = store, query

    def _collection(self, name: str) -> Collection:
        return self.store.existing(name)

    def list(self, name: str, parameters: dict[str, str] | None = None, now: int | None = None) -> dict:
        """``{data, pagination: {limit, offset, has_more}}``: a page in order of first appearance. Parameters filter as `parameters_variant`
        says; limit and offset as `query.page_bounds` does."""
        c, parameters = self._collection(name), parameters or {}
        limit, offset = page_bounds(parameters)
        docs = c.documents(now=now).withColumn("doc", F.try_parse_json("data"))
        docs = docs.where(parameters_variant(docs, parameters))
        asked = parameters.get("query") or parameters.get("q")
        if self.query is not None and asked:
            docs = self.query(docs, asked)
        rows = docs.drop("doc").orderBy("first_seen", "id").offset(offset).limit(limit + 1).collect()  # a page
        return {"data": [c._doc(r) for r in rows[:limit]], "pagination": {"limit": limit, "offset": offset, "has_more": len(rows) > limit}}

    def get(self, name: str, id: str, now: int | None = None) -> dict:
        found = self._collection(name).get(id, now=now)
        if found is None:
            raise KeyError(id)
        return found

    def put(self, name: str, id: str, body: dict) -> dict:
        """Replace a document as a whole; the id of the request counts, whatever the body says. The collection is made if need be."""
        doc = {**body, "id": id}
        (self._collection(name) if name in self.store.names() else self.store.collection(name)).put(doc)
        return doc

    def delete(self, name: str, id: str) -> dict:
        """Delete an id, whether or not there is such a document."""
        self._collection(name).delete(id)
        return {"id": id, "deleted": True}

    def search(self, name: str, request: dict, now: int | None = None) -> list[dict]:
        """``[{id, score, data}]``, best first; see `Collection.request_search`."""
        return [{"id": r["id"], "score": r["score"], "data": json.loads(r["data"])} for r in self._collection(name).request_search(request, now).collect()]

    def transaction(self, ops: list[dict]) -> int:
        return self.store.apply(ops)

    def collections(self) -> list[str]:
        return self.store.names()

    def stats(self, name: str) -> dict:
        return self._collection(name).stats()

    def compact(self, name: str) -> dict:
        return self._collection(name).compact()

    def vacuum(self, name: str) -> dict:
        return self._collection(name).vacuum()
