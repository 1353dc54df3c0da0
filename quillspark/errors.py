"""Errors that callers may catch."""


class RetrievalError(ValueError):
    """A search that can't be answered: bad arguments, bad or missing vectors."""


class StorageError(RuntimeError):
    """A collection that can't be opened or added to."""
