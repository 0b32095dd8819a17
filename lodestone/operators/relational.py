"""Projection, selection, joins, and sinks of rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import Outcome, StatementError
from lodestone.functions.conditions import exact


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The listed columns in their listed order, repeats included; all for none."""
    if columns is None:
        return df
    return df.select(*(F.col(f"`{exact(df, c)}`") for c in columns))


def natural_join(one: DataFrame, two: DataFrame, on: str | tuple[str, str], sorted_sides: bool = False) -> DataFrame:
    """Inner equi-join: the key once, then the other columns of both sides.

    Each pair of rows with equal keys comes out. Catalyst and AQE choose the physical join and
    split skewed keys; ``sorted_sides`` asks for a merge join, for sides clustered by the key.
    """
    left, right = (on, on) if isinstance(on, str) else on
    exact(one, left), exact(two, right)
    two = two.withColumnRenamed(right, left) if right != left else two
    clash = (set(one.columns) & set(two.columns)) - {left}
    if clash:
        raise StatementError(Outcome.INVALID_COLUMN, f"both sides have {sorted(clash)}")
    return one.join(two.hint("merge") if sorted_sides else two, left, "inner")


def cross_product(one: DataFrame, two: DataFrame) -> DataFrame:
    """Each row with each; asked for by name, never made by a join."""
    if clash := set(one.columns) & set(two.columns):
        raise StatementError(Outcome.INVALID_COLUMN, f"both sides have {sorted(clash)}")
    return one.crossJoin(two)


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row, ``found``: whether a row meets the condition. The scan stops at the first."""
    one = df.where(condition).limit(1).select(F.lit(1).alias("x"))
    return one.agg((F.count("*") > 0).alias("found"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def text_rows(df: DataFrame, between: str = " | ") -> DataFrame:
    """Each row as one line: floats with six decimals, the other values as they are."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.format_string("%.6f", c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.cast("string")

    return df.select(F.concat_ws(between, *(F.coalesce(shown(f), F.lit("")) for f in df.schema)).alias("line"))
