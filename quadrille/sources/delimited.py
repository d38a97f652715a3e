"""Delimited text files as a source: cells are converted to the declared kinds, bad rows are skipped and reported."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.errors import EngineError
from quadrille.functions.convert import parse_cell, parse_point
from quadrille.types import RID, TableSpec

#: Headers (in any case) from which a missing point is built, in this order.
POINT_HEADERS = (("lat", "long"), ("lat", "lng"), ("latitude", "longitude"), ("x", "y"))
#: Errors that a report describes.
SHOWN = 5


@dataclass(frozen=True)
class LoadReport:
    inserted: int
    skipped: int
    errors: tuple[str, ...] = ()


def staged(spark: SparkSession, spec: TableSpec, path: str, delimiter: str = ";") -> DataFrame:
    """The converted columns, RID in the order of the file, and __why: what is wrong with the row, or null.

    Cells may stand in double quotes, in which a quote is doubled and delimiters and line ends are text.  A file that has
    line ends in quotes can't be split between tasks; any other is.  Rows whose cells are all blank are left out.  Cells
    beyond the header are ignored, missing ones are null, and a column that the file lacks is blank.
    """
    options = {"sep": delimiter, "header": True, "mode": "PERMISSIVE", "encoding": "UTF-8", "escape": '"', "multiLine": _open_quotes(spark, path)}
    try:
        headers = spark.read.csv(path, inferSchema=False, **options).columns
    except Exception as e:
        raise EngineError(f"can't read '{path}': {str(e).splitlines()[0]}") from e
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*headers, "__odd"]])
    raw = spark.read.csv(path, schema=schema, columnNameOfCorruptRecord="__odd", **options)
    # The reader gives null for blank cells and for missing ones; a row with too few cells is kept in __odd.
    sep = re.escape(delimiter)
    bare = F.regexp_replace("__odd", rf'(^|{sep})"(?:[^"]|"")*+"', "$1")
    short = F.coalesce(F.size(F.split(bare, sep, -1)) < len(headers), F.lit(False)) & F.col("__odd").isNotNull()
    cells = [f"`{c}`" for c in headers]
    raw = raw.select(*[F.when(~short, F.coalesce(F.col(c), F.lit(""))).otherwise(F.col(c)).alias(h) for c, h in zip(cells, headers, strict=True)])
    raw = raw.withColumn(RID, F.monotonically_increasing_id())
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    if cells:
        every = blank(F.col(cells[0]))
        for c in cells[1:]:
            every = every & blank(F.col(c))
        raw = raw.where(~every)
    values, wrong = [], []
    for column in spec.columns:
        there = f"`{column.name}`" in cells
        text = F.col(f"`{column.name}`") if there else F.lit("")
        value = parse_cell(text, column)
        if column.kind == "POINT":
            value = F.when(blank(text), _from_pairs(raw.columns)).otherwise(value)
        if column.kind == "BOOL":
            value = F.when(text.isNull(), F.lit(False)).otherwise(value)  # a cell that the row is too short for
        values.append(value.alias(column.name))
        wrong.append(F.when(value.isNull(), F.concat(F.lit(f"column '{column.name}' can't hold "), F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("a missing cell")))))
    return raw.select(*values, F.col(RID), F.coalesce(*wrong, F.lit(None).cast("string")).alias("__why"))


def _open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so that cells may go on in the next line."""
    try:
        return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    except Exception as e:
        raise EngineError(f"can't read '{path}': {str(e).splitlines()[0]}") from e


def _from_pairs(headers: list[str]) -> Column:
    by = {}
    for h in headers:
        by.setdefault(h.strip().lower(), h)
    out = [F.lit(None).cast("struct<x:double,y:double>")]
    for a, b in reversed(POINT_HEADERS):
        if a in by and b in by:
            one, two = (F.trim(F.col(f"`{by[k]}`")) for k in (a, b))
            there = (F.coalesce(one, F.lit("")) != "") & (F.coalesce(two, F.lit("")) != "")
            out.append(F.when(there, parse_point(F.concat(one, F.lit(","), two))).otherwise(out[-1]))
    return out[-1]


def load(spark: SparkSession, spec: TableSpec, path: str, delimiter: str = ";", max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Good rows (declared columns and RID) and bad rows (RID and __why).

    Of rows with the same primary key the first stays.  ``max_rows`` is a parameter of the load: so many good rows stay.
    """
    rows = staged(spark, spec, path, delimiter)
    good, bad = rows.where("__why IS NULL").drop("__why"), rows.where("__why IS NOT NULL").select(RID, "__why")
    if key := spec.primary:
        # The first row of each key is found by a minimum with partial sums, so a key in very many rows isn't gathered.
        firsts = good.groupBy(F.col(f"`{key.name}`").alias("__key")).agg(F.min(RID).alias("__first"))
        is_first = good[RID] == F.col("__first")
        again = good.join(firsts, is_first, "left_anti").select(RID, F.concat(F.lit(f"primary key '{key.name}' repeats "), F.col(f"`{key.name}`").cast("string")).alias("__why"))
        good, bad = good.join(firsts, is_first, "left_semi"), bad.unionByName(again)
    if max_rows is not None:
        good = good.orderBy(RID).limit(max_rows)
        last = good.agg(F.max(RID)).first()[0]
        bad = bad.where(F.col(RID) < F.lit(last if last is not None else -1)) if max_rows else bad.limit(0)
    return good, bad


def report(inserted: int, bad: DataFrame) -> LoadReport:
    """Counts, and the first errors with their row in the file (the header is row 1)."""
    skipped = bad.count()
    shown = bad.orderBy(RID).limit(SHOWN).collect() if skipped else []
    place = lambda rid: f"row {rid + 2}" if rid < 1 << 33 else f"split {rid >> 33}, row {(rid & ((1 << 33) - 1)) + 1}"
    return LoadReport(inserted, skipped, tuple(f"{place(r[RID])}: {r['__why']}" for r in shown))
