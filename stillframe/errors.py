"""Errors with the codes that callers act on."""


class StillframeError(Exception):
    code = "INTERNAL_ERROR"


class InvalidArgument(StillframeError):
    code = "INVALID_ARGUMENT"


class IngestRejected(StillframeError):
    code = "INGEST_REJECTED"


class UnparseableBody(IngestRejected):
    code = "UNPARSEABLE_BODY"


class NotFound(StillframeError):
    code = "NOT_FOUND"


class StorageError(StillframeError):
    code = "STORAGE_ERROR"


class CommitConflict(StorageError):
    code = "STORAGE_ERROR"
