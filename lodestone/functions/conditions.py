"""Conditions as columns, for statements and for the DataFrame API alike."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import Outcome, StatementError
from lodestone.functions.types import literal

#: A condition: (column, operator, literal), or a mark and the conditions that it combines.
Tree = tuple
AND, OR, NOT = "&&", "||", "!"
OPERATORS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def exact(df: DataFrame, name: str) -> str:
    """A column's name, if the table has it in exactly these letters."""
    if name not in df.columns:
        raise StatementError(Outcome.INVALID_COLUMN, f"no column {name}")
    return name


def term(df: DataFrame, name: str, op: str, text: str, declared: dict[str, str] | None = None) -> Column:
    """``name op literal`` with the literal in the column's type. Terms combine by ``&``, ``|`` and ``~``."""
    if op not in OPERATORS:
        raise StatementError(Outcome.INVALID_OPERATOR, f"no operator {op}")
    exact(df, name)
    kind = df.schema[name].dataType
    return OPERATORS[op](F.col(f"`{name}`"), literal(text, kind, (declared or {}).get(name), in_condition=True))


def built(df: DataFrame, tree: Tree, declared: dict[str, str] | None = None) -> Column:
    """The condition as a column over ``df``."""
    match tree:
        case (mark, one) if mark == NOT:
            return ~built(df, one, declared)
        case (mark, one, two) if mark == AND:
            return built(df, one, declared) & built(df, two, declared)
        case (mark, one, two) if mark == OR:
            return built(df, one, declared) | built(df, two, declared)
    return term(df, *tree, declared)


def first_column(tree: Tree) -> str:
    """The column of a condition's first term."""
    return first_column(tree[1]) if tree[0] in (AND, OR, NOT) else tree[0]
