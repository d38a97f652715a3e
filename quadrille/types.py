"""Declared tables: column kinds, layout hints and their Spark types."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from quadrille.errors import BindError

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SPARK = {"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "VARCHAR": T.StringType(), "BOOL": T.BooleanType(), "POINT": POINT}
HINTS = ("SEQUENTIAL", "HASH", "BTREE", "RTREE")
#: Hidden column: the order in which rows came, unique in a table.
RID = "_rid"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    size: int = 0
    hint: str | None = None
    primary: bool = False


@dataclass(frozen=True)
class TableSpec:
    """Table names are case-insensitive, column names are not."""

    name: str
    columns: tuple[ColumnSpec, ...]

    def __post_init__(self):
        object.__setattr__(self, "name", self.name.lower())
        names = [c.name for c in self.columns]
        if not self.name or not names:
            raise BindError("a table needs a name and at least one column")
        if len(set(names)) < len(names):
            raise BindError(f"table {self.name} names a column twice")
        if sum(c.primary for c in self.columns) > 1:
            raise BindError(f"table {self.name} has more than one primary key")
        for c in self.columns:
            if c.kind not in SPARK:
                raise BindError(f"column {c.name} has the unknown type {c.kind}")
            if c.kind == "VARCHAR" and c.size <= 0:
                raise BindError(f"column {c.name} needs a positive length")
            if c.hint and c.hint not in HINTS:
                raise BindError(f"column {c.name} has the unknown index {c.hint}")
            if (c.hint == "RTREE") != (c.kind == "POINT" and c.hint is not None):
                raise BindError(f"column {c.name}: RTREE is for POINT columns, and the only index for them")

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise BindError(f"column '{name}' does not exist in table '{self.name}'")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary(self) -> ColumnSpec | None:
        return next((c for c in self.columns if c.primary), None)

    @property
    def schema(self) -> T.StructType:
        """The stored columns: the declared ones and RID."""
        return T.StructType([*(T.StructField(c.name, SPARK[c.kind], True, {"hint": c.hint or "", "size": c.size, "primary": c.primary}) for c in self.columns), T.StructField(RID, T.LongType())])

    def as_json(self) -> dict:
        return {"name": self.name, "columns": [asdict(c) for c in self.columns]}

    @classmethod
    def from_json(cls, value: dict) -> TableSpec:
        return cls(value["name"], tuple(ColumnSpec(**c) for c in value["columns"]))
