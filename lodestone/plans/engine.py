"""``Engine.execute``: one statement to one result, with an outcome for whatever goes wrong."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import CatalogError, Outcome, StatementError
from lodestone.functions.conditions import built, exact, first_column
from lodestone.functions.types import literal, size_of, value_of
from lodestone.operators.relational import cross_product, natural_join, project
from lodestone.plans import grammar as G
from lodestone.sources.catalog import KEY, Catalog, Table


class Result:
    """An outcome, its rows, and how many: a select's are counted when they are asked for."""

    def __init__(self, outcome: str, df: DataFrame | None = None, n: int | None = None, message: str = ""):
        self.outcome, self.df, self.message, self._n = outcome, df, message, n

    @cached_property
    def n(self) -> int | None:
        return self.df.count() if self._n is None and self.df is not None else self._n


class Engine:
    """Statements over a catalog. ``strict_index`` asks for an index as inserts and deletes once did."""

    def __init__(self, spark: SparkSession, root: str, strict_index: bool = False):
        self.spark, self.catalog, self.strict = spark, Catalog(spark, root), strict_index
        self.views: dict[str, DataFrame] = {}
        self.open = True

    def register(self, name: str, df: DataFrame) -> None:
        """A table that can only be read."""
        self.views[name] = df

    def execute(self, text: str) -> Result:
        try:
            statement = G.parse(text)
            return getattr(self, f"_{type(statement).__name__.lower()}")(statement)
        except StatementError as e:
            return Result(e.outcome, message=str(e))
        except Exception as e:  # noqa: BLE001  whatever Spark raises is an outcome too
            return Result(Outcome.UNEXPECTED, message=str(e))

    def table(self, name: str) -> DataFrame:
        """A table's rows for the DataFrame API."""
        return self.views[name] if name in self.views else self.catalog.read(self.catalog.get(name))

    def insert_many(self, name: str, rows: DataFrame) -> Result:
        """Append the rows of a DataFrame with the table's columns, under the same checks as single inserts; keys follow partitions.

        A value that cannot be cast to its column's type raises; one bad row keeps all out.
        """
        table = self.catalog.get(name)
        rows = rows.select(*(F.col(f"`{exact(rows, f.name)}`").cast(f.dataType).alias(f.name) for f in table.schema))
        staged = f"{self.catalog.root}/{name}/data-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(staged)  # keys need checks, counts and rows of one evaluation
            rows = self.spark.read.schema(table.schema).parquet(staged).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
            some = lambda condition: F.max(F.coalesce(condition, F.lit(False)))
            null, long, odd = F.lit(False), F.lit(False), F.lit(False)
            for f in table.schema:
                column, kind = F.col(f"`{f.name}`"), table.declared.get(f.name)
                null = null | column.isNull() if kind else null
                long = long | (F.char_length(column) > size_of(kind)) if size_of(kind) else long
                odd = odd | (F.char_length(column) != 1) if kind == "char" else odd
            counts = sorted(rows.groupBy("_file").agg(F.count("*"), some(null), some(long), some(odd)).toLocalIterator())  # one row a file
            if any(r[2] or r[4] for r in counts):
                raise StatementError(Outcome.TYPE_MISMATCH, "a value is null, or no char")
            if any(r[3] for r in counts):
                raise StatementError(Outcome.STRING_TOO_LARGE)
            before, total = [], table.next_key
            for file, n, *_ in counts:
                before.append((file, total))
                total += n
            offsets = self.spark.createDataFrame(before, "_file string, _before long")
            keyed = rows.join(offsets, "_file").withColumn(KEY, F.col("_before") + F.col("_index")).drop("_file", "_index", "_before")
            self.catalog.append(table, keyed, total - table.next_key)
        except StatementError as e:
            return Result(e.outcome, message=str(e))
        finally:
            self.catalog.remove(staged)
        return Result(Outcome.SUCCESS, n=total - table.next_key)

    def remove(self, name: str, column: str, value: str, key: int) -> bool:
        """Delete the one row with this value and this hidden key; whether there was one."""
        table = self._own(name)
        found = built(self.catalog.read(table, hidden=True), ("&&", (self._known(table, column), "==", value), (KEY, "==", str(key))), table.declared)
        return self._without(table, found) > 0

    # ------------------------------------------------------------------ statements

    def _meta(self, s: G.Meta) -> Result:
        self.open = self.open and s.outcome != Outcome.EXIT
        return Result(s.outcome)

    def _create(self, s: G.Create) -> Result:
        if s.table in self.views:
            raise CatalogError("tableAlreadyExists")
        self.catalog.create(s.table, s.columns)
        return Result(Outcome.SUCCESS)

    def _index(self, s: G.Index) -> Result:
        table = self._own(s.table)
        for c in s.columns:
            self._known(table, c)
        self.catalog.index(table, s.columns)
        return Result(Outcome.SUCCESS)

    def _insert(self, s: G.Insert) -> Result:
        table = self._own(s.table)
        if self.strict and not table.indexes:
            raise StatementError(Outcome.NOT_INDEXED)
        if len(s.values) != len(table.schema):
            raise StatementError(Outcome.FAILURE, f"{len(table.schema)} values are asked for")
        row = [value_of(v, f.dataType, table.declared.get(f.name)) for v, f in zip(s.values, table.schema, strict=True)]
        schema = T.StructType([*table.schema, *([T.StructField(KEY, T.LongType())] if table.keyed else [])])
        one = self.spark.createDataFrame([(*row, *([table.next_key] if table.keyed else []))], schema)
        self.catalog.append(table, one.coalesce(1), 1)
        return Result(Outcome.SUCCESS, n=1)

    def _select(self, s: G.Select) -> Result:
        df, declared = self._rows(s.table)
        if s.other is not None:
            other, more = self._rows(s.other, hidden=False)
            df, declared = df.drop(KEY), declared | more
            df = natural_join(df, other, s.on) if s.on else cross_product(df, other)
        rows = df.where(built(df, s.where, declared)) if s.where else df
        if s.order:
            by, desc = F.col(f"`{exact(df, s.order[0])}`"), s.order[1]
            rows = rows.orderBy(*(c.desc() if desc else c.asc() for c in (by, *([F.col(KEY)] if KEY in df.columns else []))))
        return Result(Outcome.SUCCESS, project(rows, [c for c in rows.columns if c != KEY] if s.columns is None else s.columns))

    def _update(self, s: G.Update) -> Result:
        table = self._own(s.table)
        df = self.catalog.read(table, hidden=True)
        new = {self._known(table, c): literal(v, table.schema[c].dataType, table.declared.get(c)) for c, v in s.values}
        if len(new) < len(s.values):
            raise StatementError(Outcome.SYNTAX_ERROR, "a column is set twice")
        found = built(df, s.where, table.declared) if s.where else F.lit(True)
        touched = self.catalog.touched(table, found)
        if touched:
            met = F.coalesce(found, F.lit(False))  # files that the engine has not written may hold nulls
            self.catalog.rewrite(table, list(touched), lambda rows: rows.withColumns({c: F.when(met, v).otherwise(F.col(f"`{c}`")) for c, v in new.items()}))
        return Result(Outcome.SUCCESS, n=sum(touched.values()))

    def _delete(self, s: G.Delete) -> Result:
        table = self._own(s.table)
        df = self.catalog.read(table, hidden=True)
        found = built(df, s.where, table.declared)
        if self.strict and first_column(s.where) not in table.indexes:
            raise StatementError(Outcome.NOT_INDEXED)
        return Result(Outcome.SUCCESS, df.where(found).drop(KEY), self._without(table, found))

    def _without(self, table: Table, found: Column) -> int:
        """Publish the table without the rows found; their number."""
        touched = self.catalog.touched(table, found)
        if touched:
            self.catalog.rewrite(table, list(touched), lambda rows: rows.where(~F.coalesce(found, F.lit(False))))
        return sum(touched.values())

    def _deleteall(self, s: G.DeleteAll) -> Result:
        table = self._own(s.table)
        n = self.catalog.read(table).count()
        self.catalog.replace(table, None)
        return Result(Outcome.SUCCESS, n=n)

    def _drop(self, s: G.Drop) -> Result:
        self._own(s.table)
        self.catalog.drop(s.table)
        return Result(Outcome.SUCCESS)

    # ------------------------------------------------------------------ helpers

    def _rows(self, name: str, hidden: bool = True) -> tuple[DataFrame, dict[str, str]]:
        """A table's rows, with their hidden key where they have one, and its declared types."""
        if name in self.views:
            return self.views[name], {}
        table = self.catalog.get(name)
        return self.catalog.read(table, hidden), table.declared

    def _own(self, name: str) -> Table:
        if name in self.views:
            raise CatalogError("readOnly", f"{name} can only be read")
        return self.catalog.get(name)

    @staticmethod
    def _known(table: Table, column: str) -> str:
        if column not in table.schema.names:
            raise StatementError(Outcome.INVALID_COLUMN, f"no column {column}")
        return column
