"""What can go wrong with a versioned store, as classes to catch."""


class StoreError(Exception):
    pass


class NotFoundError(StoreError):
    pass


class AlreadyExistsError(StoreError):
    pass


class InvalidArgumentError(StoreError):
    pass


class InvalidParentError(StoreError):
    pass


class SchemaMismatchError(StoreError):
    pass


class SchemaConflictError(StoreError):
    pass


class TypeMismatchError(SchemaMismatchError):
    pass


class NullViolationError(SchemaMismatchError):
    pass


class WriterBusyError(StoreError):
    pass


class ReadOnlyError(StoreError):
    pass


class ClosedError(StoreError):
    pass


class SnapshotCommittedError(StoreError):
    pass


class MustReopenError(StoreError):
    pass


class LimitExceededError(StoreError):
    pass


class VersionUnsupportedError(StoreError):
    pass


class KeyRequiredError(StoreError):
    pass


class KeyUnavailableError(StoreError):
    pass


class CorruptDataError(StoreError):
    pass


class AuthFailedError(CorruptDataError):
    pass


class CommitError(StoreError):
    """unknown: whether the snapshot became durable is not known; the store must be opened again."""

    def __init__(self, message: str, unknown: bool = False):
        super().__init__(message)
        self.unknown = unknown
