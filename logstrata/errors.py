"""What can go wrong, as exceptions of one family."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all errors here."""


class InvalidNameError(StoreError):
    """A collection's name isn't 1 to 64 letters, digits, `_` or `-` that begin with a letter or digit."""


class SizeLimitError(StoreError):
    def __init__(self, size: int, limit: int):
        super().__init__(f"a batch of {size} characters exceeds the limit of {limit}")
        self.size, self.limit = size, limit


class PreconditionFailedError(StoreError):
    """What was to be replaced isn't what it was."""


class LockError(StoreError):
    """Something about a lease."""


class LockActiveError(LockError):
    """Another writer published first, or holds the maintenance lease."""


class LockAcquisitionError(LockError):
    """The lease couldn't be written."""


class OptionsMismatchError(StoreError):
    """A collection was opened with other options than it was made with."""


class CorruptionError(StoreError):
    """Stored files don't hold what the manifest says."""


class InvalidVectorError(StoreError):
    """A vector isn't an array of finite numbers."""


class VectorDimensionError(InvalidVectorError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"a vector has {found} elements, not {expected}")
        self.expected, self.found = expected, found


class TransactionError(StoreError):
    """A transaction failed and was undone; ``failures`` are the compensations that failed themselves."""

    def __init__(self, cause: BaseException, failures: list[BaseException]):
        super().__init__(f"undone after: {cause}" + (f"; {len(failures)} compensations failed" if failures else ""))
        self.cause, self.failures = cause, failures
