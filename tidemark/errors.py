"""Errors with their SQLSTATE."""

from __future__ import annotations


class EngineError(Exception):
    sqlstate = "XX000"


class NotNullViolation(EngineError):
    sqlstate = "23502"


class UniqueViolation(EngineError):
    sqlstate = "23505"


class SerializationFailure(EngineError):
    """A commit lost against another one."""

    sqlstate = "40001"


class StatementUnknown(EngineError):
    """Part of a commit may have taken effect."""

    sqlstate = "40003"


class NotSupported(EngineError):
    sqlstate = "0A000"


class FailedTransaction(EngineError):
    """The transaction was aborted by an earlier error."""

    sqlstate = "25P02"


class InsufficientPrivilege(EngineError):
    sqlstate = "42501"


class UndefinedTable(EngineError):
    sqlstate = "42P01"


class UndefinedColumn(EngineError):
    sqlstate = "42703"


class DuplicateTable(EngineError):
    sqlstate = "42P07"


class InvalidName(EngineError):
    sqlstate = "42602"
