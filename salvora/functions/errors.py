"""Typed failures of a document; in DataFrames they are columns, never a failed job."""

from __future__ import annotations


class DocumentError(Exception):
    kind = "InvalidData"


class NotFound(DocumentError):
    kind = "NotFound"


class Unsupported(DocumentError):
    kind = "Unsupported"


class LimitExceeded(DocumentError):
    """A resource would go beyond its limit; `actual` equal to `limit` is allowed."""

    kind = "ResourceLimit"

    def __init__(self, resource: str, limit: int, actual: int):
        super().__init__(f"{resource}: {actual} is above the limit of {limit}")
        self.resource, self.limit, self.actual = resource, limit, actual
