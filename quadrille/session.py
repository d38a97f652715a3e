"""The engine: statements in, DataFrames or statuses out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quadrille.errors import BindError
from quadrille.plans.dialect import Create, Delete, Insert, Select, parse
from quadrille.plans.lower import literal_pair, lower
from quadrille.sources.catalog import Catalog


@dataclass(frozen=True)
class Status:
    message: str
    affected_rows: int = 0
    status: str = "ok"


@dataclass
class Stats:
    """Of the last text: seconds, statements, and what the plans of its queries contain."""

    time_ms: float = 0.0
    statements: int = 0
    sorts: bool = False
    joins: bool = False
    groups: bool = False
    kinds: list[str] = field(default_factory=list)


class Engine:
    """``root`` is the folder of the tables.

    A text is parsed whole before anything runs; it runs statement by statement, and what was done before an error
    stays.  The comment --replacement, which once chose a sort algorithm, is a comment.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.catalog, self.stats = Catalog(spark, root), Stats()

    def run(self, text: str) -> list[DataFrame | Status]:
        began, statements = time.perf_counter(), parse(text)
        self.stats = Stats(statements=len(statements), kinds=[type(s).__name__.upper() for s in statements])
        out = []
        for s in statements:
            if isinstance(s, Select):
                self.stats.sorts |= s.order is not None
                self.stats.joins |= s.join is not None
                self.stats.groups |= s.group is not None
            out.append(self._one(s))
        self.stats.time_ms = (time.perf_counter() - began) * 1000
        return out

    def _one(self, s) -> DataFrame | Status:
        if isinstance(s, Select):
            return lower(self.catalog, s)
        if isinstance(s, Create):
            told = self.catalog.create(s.spec, s.source)
            loaded = f", {told.inserted} rows loaded, {told.skipped} skipped" if s.source is not None else ""
            return Status(f"table '{s.spec.name}' created{loaded}", told.inserted)
        if isinstance(s, Insert):
            self.catalog.insert(s.table, [literal_pair(v) for v in s.values])
            return Status(f"1 row inserted into '{s.table.lower()}'", 1)
        if isinstance(s, Delete):
            if s.ref.table and s.ref.table.lower() != s.table.lower():
                raise BindError(f"table '{s.ref.table}' is not part of the statement")
            gone = self.catalog.delete_equal(s.table, s.ref.name, *literal_pair(s.value))
            return Status(f"{gone} rows deleted from '{s.table.lower()}'", gone)
        raise AssertionError(s)
