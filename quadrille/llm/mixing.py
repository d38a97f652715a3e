"""Mixing sources to target weights by Poisson replication.

A source with target share w and size s, out of a total of t, gets the mean repetition rate w * epochs * t / s.  Each
document draws a uniform number from a hash of the seed and its doc_id, the inverse of the Poisson distribution with its
source's rate turns it into a count, the document is exploded into so many copies, and all copies are dealt out and
ordered by a hash.  Draws depend on nothing but seed and doc_id, so a lost task is redone alike.

Defined cases: a source without a weight of its own (null too) belongs to the group of the others, which shares
``other_weight``.  Groups without text get no copies and their weight falls to the rest.  A null or empty text has size
0; such a document is drawn at its source's rate.  Rows with the same doc_id draw the same count; a null doc_id is one
more id.  Columns named copies, copy or shuffle_key in the input are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import whole

OTHER = "\0other"
#: Above this rate a draw is the sum of draws at equal smaller rates, as exp(-rate) would vanish.
MOST_RATE = 500.0


def hashed(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of an MD5 over the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def poisson_steps(rate: float) -> list[float]:
    """Values of the distribution function at 0, 1, 2 ... until it can't be told from 1."""
    out, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        out.append(total)
        k += 1
        term *= rate / k
        if k > rate and total + term == total:
            return out


def rates(sizes: dict[str, float], weights: dict[str, float], epochs: float = 1.0) -> dict[str, float]:
    """Mean repetitions for each group that has any text."""
    present = {k: w for k, w in weights.items() if sizes.get(k, 0) > 0 and w > 0}
    total, share = sum(sizes.values()), sum(present.values())
    return {k: w / share * epochs * total / sizes[k] for k, w in present.items()}


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float = 0.0, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of the rows, with copies (the draw), copy (from 0) and shuffle_key, in the order of a global shuffle."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copies", "copy", "shuffle_key")])
    group = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)).otherwise(F.lit(OTHER))
    # One row for each weight at most, whatever the corpus.
    sizes = {r[0]: float(r[1]) for r in docs.groupBy(group.alias("g")).agg(F.sum(F.length(whole(text_col))).alias("n")).collect()}
    steps = [(k, math.ceil(r / MOST_RATE), poisson_steps(r / math.ceil(r / MOST_RATE))) for k, r in sorted(rates(sizes, weights | {OTHER: other_weight}, epochs).items())]
    table = docs.sparkSession.createDataFrame(steps, "__group string, __draws int, __steps array<double>")
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))

    def draw(k: Column) -> Column:
        u = hashed(13, F.lit(f"{seed}"), ident, k.cast("string")) / F.lit(float(16**13))
        return F.size(F.filter("__steps", lambda x: x <= u))

    drawn = (
        docs.withColumn("__group", group)
        .join(F.broadcast(table), "__group")
        .withColumn("copies", F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda a, k: a + draw(k)))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("shuffle_key", hashed(15, F.lit(f"{seed}"), ident, F.lit("copy"), F.col("copy").cast("string")))
        .drop("__group", "__draws", "__steps")
    )
    return drawn.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*docs.columns, "copies", "copy", "shuffle_key")
