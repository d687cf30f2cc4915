"""Errors that callers can tell apart."""


class DataError(ValueError):
    """A condition, path, schema or option that can't be used as given."""


class ValidationError(DataError):
    """Rows that break a schema."""
