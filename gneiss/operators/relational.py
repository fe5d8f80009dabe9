"""A fluent query that builds a lazy DataFrame; Catalyst plans it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp, "variance": F.var_samp, "approx_count_distinct": F.approx_count_distinct,
}


class Query:
    """Collects clauses in any order; to_df() applies them in SQL's order, set operations before order and limit."""

    def __init__(self, source: DataFrame, alias: str | None = None):
        self._source = source.alias(alias) if alias else source
        self._columns: list[Column] = []
        self._aggregates: list[Column] = []
        self._where: list[Column] = []
        self._joins: list[tuple] = []
        self._group: list[Column] = []
        self._having: list[Column] = []
        self._grouping: str | None = None
        self._sets: list[tuple[str, DataFrame]] = []
        self._order: list[Column] = []
        self._limit: int | None = None
        self._offset = 0

    def select(self, *columns: str) -> Query:
        self._columns += [F.expr(c) for c in columns]
        return self

    def select_as(self, expression: str, alias: str) -> Query:
        self._columns.append(F.expr(expression).alias(alias))
        return self

    def aggregate(self, kind: str, column: str, alias: str) -> Query:
        self._aggregates.append(AGGREGATES[kind](F.lit(1) if column == "*" else F.expr(column)).alias(alias))
        return self

    def where(self, condition: str | Column) -> Query:
        self._where.append(F.expr(condition) if isinstance(condition, str) else condition)
        return self

    def where_equals(self, column: str, value) -> Query:
        return self.where(F.col(column) == F.lit(value))

    def where_in(self, column: str, values: list) -> Query:
        return self.where(F.col(column).isin(values))

    def where_between(self, column: str, low, high) -> Query:
        return self.where(F.col(column).between(low, high))

    def where_any(self, *conditions: str) -> Query:
        """Rows that meet one of the conditions."""
        return self.where(reduce(lambda a, b: a | b, map(F.expr, conditions)))

    def where_prefix(self, column: str, prefix: str) -> Query:
        return self.where(F.col(column).startswith(prefix))

    def where_contains(self, column: str, part: str) -> Query:
        return self.where(F.col(column).contains(part))

    def join(self, other: DataFrame, on: str | None, how: str = "inner", alias: str | None = None) -> Query:
        """how: inner, left, right, full, cross, left_semi or left_anti."""
        if (on is None) != (how == "cross"):
            raise ValueError("every join but a cross join needs a condition")
        self._joins.append((other.alias(alias) if alias else other, on, how))
        return self

    def group_by(self, *columns: str) -> Query:
        self._group += [F.expr(c) for c in columns]
        return self

    def rollup(self, *columns: str) -> Query:
        self._grouping = "rollup"
        return self.group_by(*columns)

    def cube(self, *columns: str) -> Query:
        self._grouping = "cube"
        return self.group_by(*columns)

    def grouping_sets(self, sets: list[list[str]]) -> Query:
        """Groups by each set of columns; columns that a set leaves out are null in its rows."""
        self._grouping = "sets"
        self._group_sets = [[F.col(c) for c in one] for one in sets]
        return self.group_by(*dict.fromkeys(c for one in sets for c in one))

    def union(self, other: Query | DataFrame, distinct: bool = True) -> Query:
        return self._combined("union" if distinct else "union_all", other)

    def intersect(self, other: Query | DataFrame) -> Query:
        return self._combined("intersect", other)

    def difference(self, other: Query | DataFrame) -> Query:
        """The distinct rows that other does not have."""
        return self._combined("except", other)

    def _combined(self, how: str, other: Query | DataFrame) -> Query:
        self._sets.append((how, other.to_df() if isinstance(other, Query) else other))
        return self

    def having(self, condition: str) -> Query:
        self._having.append(F.expr(condition))
        return self

    def order_by(self, column: str, descending: bool = False) -> Query:
        self._order.append(F.expr(column).desc() if descending else F.expr(column).asc())
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    def to_df(self) -> DataFrame:
        df = self._source
        for other, on, how in self._joins:
            df = df.crossJoin(other) if how == "cross" else df.join(other, F.expr(on), how)
        for condition in self._where:
            df = df.where(condition)
        if self._aggregates or self._grouping:
            if self._grouping == "sets":
                grouped = df.groupingSets(self._group_sets, *self._group)
            else:
                grouped = getattr(df, self._grouping or "groupBy")(*self._group)
            # a grouping without an aggregate still has a row for each of its groups
            df = grouped.agg(*self._aggregates) if self._aggregates else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        elif self._group:
            df = df.select(*self._group).distinct()
        for condition in self._having:
            df = df.where(condition)
        if self._columns:  # beside aggregates these are columns of the groups
            made = df.columns[len(self._group) :] if self._aggregates else []
            df = df.select(*self._columns, *[F.col(f"`{c}`") for c in made])
        for how, other in self._sets:
            if how == "union_all":
                df = df.union(other)
            else:
                df = {"union": lambda a, b: a.union(b).distinct(), "intersect": DataFrame.intersect, "except": DataFrame.subtract}[how](df, other)
        if self._order:
            df = df.orderBy(*self._order)
        if self._offset:
            df = df.offset(self._offset)
        return df if self._limit is None else df.limit(self._limit)
