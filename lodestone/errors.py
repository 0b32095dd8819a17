"""Outcomes of statements. The names are part of the contract."""

from __future__ import annotations


class Outcome(str):
    SUCCESS = "success"
    # while parsing
    UNRECOGNIZED = "unrecognized"
    SYNTAX_ERROR = "syntaxError"
    INVALID_TYPE = "invalidType"
    INVALID_OPERATOR = "invalidOperator"
    DIFFERENT_ROWS = "comparisonOnDifferentRows"
    EMPTY_TABLE = "cannotCreateEmptyTable"
    NO_TABLE_NAME = "noTableName"
    NO_INSERT_DATA = "noInsertData"
    NO_UPDATE_DATA = "noUpdateData"
    NO_CONDITION = "noCondition"
    NO_SIZE = "noSizeForString"
    # while executing
    TYPE_MISMATCH = "typeMismatch"
    STRING_TOO_LARGE = "stringTooLarge"
    INVALID_COLUMN = "invalidColumnName"
    NOT_INDEXED = "tableNotIndexed"
    FAILURE = "failure"
    UNEXPECTED = "unexpectedError"
    # of dot commands
    EXIT = "exit"
    EMPTY = "empty"


class StatementError(Exception):
    def __init__(self, outcome: str, message: str = ""):
        super().__init__(message or outcome)
        self.outcome = outcome


class CatalogError(StatementError):
    def __init__(self, reason: str, message: str = ""):
        super().__init__(Outcome.FAILURE, message or reason)
        self.reason = reason
