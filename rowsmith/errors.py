"""Errors raised by the library; nothing is reported as a string inside a result."""


class RowsmithError(Exception):
    """Base of all errors below."""


class SourceRejected(RowsmithError):
    """The input is not a file or a table this library accepts."""


class ContractViolation(RowsmithError):
    """Scoring rows lack a column the model was trained on."""


class ModelNotFound(RowsmithError):
    """No saved model under that reference."""


class UnsuitableTarget(RowsmithError):
    """The target cannot be used for the requested task."""
