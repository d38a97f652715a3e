"""The query operators, as functions from DataFrames to DataFrames.  All are lazy and leave physical choices to Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.errors import BindError
from quadrille.functions.points import distance, within
from quadrille.scratch import materialise


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name."""
    if name not in df.columns:
        raise BindError(f"column '{name}' does not exist; there are {', '.join(df.columns)}")
    return df[f"`{name}`"]


def scan(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """All rows; in the order of a column only if asked, as that takes a sort."""
    return df.orderBy(named(df, order_by)) if order_by else df


def read_row(df: DataFrame, id_col: str, row_id: int) -> DataFrame:
    return df.where(named(df, id_col) == F.lit(row_id))


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[named(df, n) for n in names])


def filter_equal(df: DataFrame, name: str, value: Column | object) -> DataFrame:
    """Rows whose column equals a value; a point is compared by both coordinates, which reach the Parquet reader."""
    c = named(df, name)
    if isinstance(value, tuple):
        x, y = value
        return df.where((c["x"] == F.lit(float(x))) & (c["y"] == F.lit(float(y))))
    return df.where(c == (value if isinstance(value, Column) else F.lit(value)))


def filter_range(df: DataFrame, name: str, low: Column | object, high: Column | object) -> DataFrame:
    """Both ends belong to the range; text compares by code points, points by x and then y."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return df.where(named(df, name).between(low, high))


def within_radius(df: DataFrame, name: str, x: float, y: float, radius: float) -> DataFrame:
    if radius < 0:
        raise BindError("a radius can't be negative")
    return df.where(within(named(df, name), x, y, radius))


def nearest(df: DataFrame, name: str, x: float, y: float, k: int, tie: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """The k rows nearest to a place, with _distance rounded; ties are broken by the columns of ``tie``.

    Each task keeps k rows and only those are merged, so the cost is one pass whatever the size.
    """
    if k < 0:
        raise BindError("K can't be negative")
    far = df.withColumn("__far", distance(named(df, name), x, y))
    best = far.orderBy(F.col("__far"), *[F.col(f"`{t}`") for t in tie]).limit(k)
    return best.withColumn("_distance", F.round("__far", digits)).drop("__far")


def equi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_name: str, right_name: str, separator: str = ".") -> DataFrame:
    """Inner join on one key each, columns named table.column, left ones first.  Spark picks the build side and the kind of join."""
    named(left, left_on), named(right, right_on)
    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        raise BindError(f"{left_name}.{left_on} and {right_name}.{right_on} have different types")
    side = lambda df, table: df.select(*[df[f"`{c}`"].alias(f"{table}{separator}{c}") for c in df.columns])
    one, two = side(left, left_name), side(right, right_name)
    return one.join(two, one[f"`{left_name}{separator}{left_on}`"] == two[f"`{right_name}{separator}{right_on}`"], "inner")


def sort_keys(df: DataFrame, name: str, descending: bool = False, tie: Sequence[str] = ()) -> list[Column]:
    """Sort expressions: points by x alone; the order of ties turns round with the direction."""
    c = named(df, name)
    key = c["x"] if isinstance(df.schema[name].dataType, T.StructType) else c
    keys = [key, *[named(df, t) for t in tie]]
    return [k.desc() if descending else k.asc() for k in keys]


def order_rows(df: DataFrame, name: str, descending: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*sort_keys(df, name, descending, tie))


def ranked(df: DataFrame, name: str, descending: bool = False, tie: Sequence[str] = (), as_col: str = "rank") -> DataFrame:
    """The place of each row in an order, from 1.

    Rows are range-partitioned and sorted, the sizes of the partitions (one row each) are summed, and each row adds its
    place inside its partition, so that no task sees all rows.
    """
    keys = sort_keys(df, name, descending, tie)
    # Written once: the places must be those that were counted.
    parts = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    parts = parts.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(before), "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__at") + 1).alias(as_col))


def group_count(df: DataFrame, name: str, as_col: str = "COUNT(*)") -> DataFrame:
    return df.groupBy(named(df, name)).agg(F.count(F.lit(1)).alias(as_col))


def count_rows(df: DataFrame, as_col: str = "COUNT(*)") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(as_col))


def without_equal(df: DataFrame, name: str, value: Column | object) -> DataFrame:
    """What stays after deleting the rows that equal a value."""
    c = named(df, name)
    value = value if isinstance(value, Column) else F.lit(value)
    return df.where(~c.eqNullSafe(value))


def with_row(df: DataFrame, values: Sequence[object]) -> DataFrame:
    """The rows and one more, given by position."""
    if len(values) != len(df.columns):
        raise BindError(f"{len(df.columns)} values are needed, not {len(values)}")
    return df.unionByName(df.sparkSession.createDataFrame([tuple(values)], df.schema))
