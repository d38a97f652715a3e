"""From SELECT trees to DataFrames: names are bound, literals take the kind of their column."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadrille.errors import BindError
from quadrille.functions.convert import literal
from quadrille.operators import relational as op
from quadrille.plans.dialect import Between, Equals, Literal, Nearest, Radius, Ref, Select
from quadrille.sources.catalog import Catalog
from quadrille.types import RID, ColumnSpec, TableSpec


class Scope:
    """The tables of a statement: where a reference points, and what its column is called in the DataFrame."""

    def __init__(self, specs: list[TableSpec], prefixed: bool):
        self.specs, self.prefixed = specs, prefixed

    def find(self, ref: Ref) -> tuple[int, ColumnSpec]:
        if ref.table is not None:
            at = [k for k, s in enumerate(self.specs) if s.name == ref.table.lower()]
            if not at:
                raise BindError(f"table '{ref.table}' is not part of the statement")
            return at[0], self.specs[at[0]].column(ref.name)
        at = [k for k, s in enumerate(self.specs) if ref.name in s.names]
        if len(at) > 1:
            raise BindError(f"column '{ref.name}' is ambiguous")
        if not at:
            raise BindError(f"column '{ref.name}' does not exist in {' or '.join(repr(s.name) for s in self.specs)}")
        return at[0], self.specs[at[0]].column(ref.name)

    def named(self, ref: Ref) -> tuple[str, ColumnSpec]:
        k, column = self.find(ref)
        return (f"{self.specs[k].name}.{column.name}" if self.prefixed else column.name), column


def lower(catalog: Catalog, query: Select) -> DataFrame:
    """The DataFrame of a SELECT.  Rows are in an order only where it is asked for; equal keys then keep their order of insertion."""
    specs, rows = [catalog.spec(query.table)], catalog.read(query.table)
    tie = [RID]
    if query.join:
        specs.append(catalog.spec(query.join.table))
        if specs[0].name == specs[1].name:
            raise BindError("a table can't be joined with itself")
        both = Scope(specs, True)
        ends = sorted((both.find(r) for r in (query.join.one, query.join.other)), key=lambda x: x[0])
        if ends[0][0] == ends[1][0]:
            raise BindError("both sides of ON name the same table")
        rows = op.equi_join(rows, catalog.read(query.join.table), ends[0][1].name, ends[1][1].name, specs[0].name, specs[1].name)
        tie = [f"{s.name}.{RID}" for s in specs]
    scope = Scope(specs, query.join is not None)
    columns = [f"{s.name}.{n}" if query.join else n for s in specs for n in s.names]
    if query.where:
        rows = _filter(rows, scope, query.where, tie)
        columns += ["_distance"] if isinstance(query.where, Nearest) else []
    if query.group:
        name, column = scope.named(query.group)
        grouped = op.group_count(rows, name)
        if query.order:
            by, _ = scope.named(query.order)
            if by != name:
                raise BindError("groups can only be ordered by their key")
            return op.order_rows(grouped, name, query.descending)
        return grouped
    if query.counts:
        if query.columns:
            raise BindError("COUNT(*) beside columns needs GROUP BY")
        return op.count_rows(rows)
    if query.order:
        rows = op.order_rows(rows, scope.named(query.order)[0], query.descending, tie)
    if query.columns:
        columns = [scope.named(r)[0] for r in query.columns]
    return op.project(rows, columns)


def _filter(rows: DataFrame, scope: Scope, where, tie: list[str]) -> DataFrame:
    name, column = scope.named(where.ref)
    value = lambda v: literal(column, v.kind, v.value)
    if isinstance(where, Equals):
        return op.filter_equal(rows, name, where.value.value if column.kind == "POINT" and where.value.kind == "POINT" else value(where.value))
    if isinstance(where, Between):
        return op.filter_range(rows, name, value(where.low), value(where.high))
    if column.kind != "POINT":
        raise BindError(f"column '{column.name}' is no POINT")
    x, y = where.centre.value
    if isinstance(where, Radius):
        return op.within_radius(rows, name, x, y, where.radius)
    return op.nearest(rows, name, x, y, where.k, tie)


def literal_pair(value: Literal) -> tuple[str, object]:
    return value.kind, value.value
