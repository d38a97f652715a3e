"""What the corpus operators share: bounded broadcasts and skew-safe look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.scratch import materialise, scratch_dir  # noqa: F401

#: A table of at most this many narrow rows may be broadcast; it is counted first, and beyond it rows are shuffled.
BROADCAST_ROWS = 200_000
#: A key that holds at least one row in HOT_SHARE is hot; there are at most HOT_SHARE such keys, whatever the input.
HOT_SHARE = 1024

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written narrow table, if a count proves it small; otherwise the table as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def look_up(left: DataFrame, key: str, table: DataFrame, weight: str, total: int, unique: str) -> DataFrame:
    """Left join of ``left`` to a written ``table`` with one row per ``key``.

    ``weight`` is the number of left rows that a key has, ``total`` that of all left rows.  A table that is counted and found small is
    broadcast.  Otherwise the keys with at least total / HOT_SHARE rows, of which there are at most HOT_SHARE, are
    broadcast and the rest is joined by a shuffle in which no key is hot; rows already served are dealt out by
    ``unique``, a column that differs between rows.
    """
    if table.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(table), key, "left")
    bar = max(1, total // HOT_SHARE)
    values = [c for c in table.columns if c != key]
    hot = table.where(F.col(weight) >= bar).select(F.col(key), *[F.col(c).alias(f"__hot_{c}") for c in values])
    rest = table.where(F.col(weight) < bar).withColumnRenamed(key, "__rest_key")
    served = F.col(f"__hot_{weight}").isNotNull()
    spread = F.xxhash64(unique).cast(left.schema[key].dataType)
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__rest_key", F.when(served, spread).otherwise(F.col(key)))
    joined = dealt.join(rest, "__rest_key", "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.when(served, F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def short_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, so many at a time: what a worker makes of whole texts stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
