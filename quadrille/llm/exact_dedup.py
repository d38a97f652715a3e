"""Exact dedup by skew-safe combining (native).

Rows are deduplicated inside each task, the survivors are merged in salted groups, and the winners of the salts are
combined globally.  Every stage groups by the digest *and* the whole normalised text, so that a digest that two texts
share never merges them.

Defined cases: a null text counts as empty; all empty texts are equal.  A null doc_id loses to every other; a group of
null ids alone has a null keep_id.  Rows that repeat both the kept id and the text are all marked ``kept`` by
``annotate``; ``drop_duplicates`` leaves one of them.  An empty table gives an empty result.  Other columns of the
input are carried by ``drop_duplicates`` and ignored by ``annotate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import SPACE, look_up, materialise, whole

#: Parts into which a group is dealt before its last combination.
SALTS = 16


def _normal(text: str):
    return F.regexp_replace(whole(text), SPACE, " ")


def _digest(normal, bits: int):
    digest = F.sha2(normal, 256)
    return digest if bits == 256 else F.substring(digest, 1, bits // 4)


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, salts: int = SALTS) -> DataFrame:
    """One row for each distinct normalised text: digest, normal, keep_id, group_size.  Lazy."""
    rows = docs.select(F.col(id_col).alias("id"), _normal(text_col).alias("normal")).select(
        "id", "normal", _digest(F.col("normal"), bits).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    # The partial aggregate of this grouping is the local dedup: a task sends one row for each text, however many copies it has.
    salted = rows.groupBy("digest", "normal", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "normal").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _marked(docs: DataFrame, id_col: str, text_col: str, bits: int, salts: int) -> DataFrame:
    """The rows of docs with __keep_id, __group_size and __sha; the groups of two or more are found first, and written."""
    found = winners(docs, id_col, text_col, bits, salts)
    # One row for each digest.  A digest of several texts keeps them, to be told apart by content; a text alone in its
    # digest needs none.
    groups = materialise(
        found.groupBy("digest").agg(
            F.sum("group_size").alias("rows"),
            F.count(F.lit(1)).alias("texts"),
            F.min("keep_id").alias("keep_id"),
        ).where("rows > 1"),
        "exact-groups",
    )
    held = docs.withColumn("__normal", _normal(text_col)).withColumn("__digest", _digest(F.col("__normal"), bits))
    held = held.withColumn("__sha", F.col("__digest") if bits == 256 else F.sha2(F.col("__normal"), 256))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    table = groups.select(F.col("digest").alias("__digest"), F.col("rows").alias("__rows"), F.col("texts").alias("__texts"), F.col("keep_id").alias("__keep"))
    clash = groups.where("texts > 1")
    if clash.isEmpty():
        joined = look_up(held, "__digest", table, "__rows", total, id_col)
        keep, size = F.col("__keep"), F.col("__rows")
    else:
        # Rare by construction: some digest has several texts.  Those texts, and only those, are joined by content.
        texts = materialise(
            found.join(clash.select("digest"), "digest", "left_semi").select(
                F.col("normal").alias("__normal"), F.col("keep_id").alias("__own_keep"), F.col("group_size").alias("__own_rows")
            ),
            "exact-clashes",
        )
        joined = look_up(look_up(held, "__digest", table, "__rows", total, id_col), "__normal", texts, "__own_rows", total, id_col)
        several = F.col("__texts") > 1
        keep, size = F.when(several, F.col("__own_keep")).otherwise(F.col("__keep")), F.when(several, F.col("__own_rows")).otherwise(F.col("__rows"))
    return joined.withColumn("__size", F.coalesce(size, F.lit(1)).cast("long")).withColumn("__keep_id", F.when(F.col("__rows").isNull(), F.col(id_col)).otherwise(keep))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256, salts: int = SALTS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.  ``bits`` shortens the grouping digest, for tests."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _marked(docs, "doc_id", "text", bits, salts).select(
        "doc_id",
        F.col("__keep_id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep_id")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    marked = _marked(docs, id_col, text_col, 256, SALTS)
    mine = F.col(id_col).eqNullSafe(F.col("__keep_id"))
    # Groups in which the kept id itself is repeated need one more grouping; only their rows go through it.
    held = marked.where(mine & (F.col("__size") > 1)).select(F.col(id_col).alias("id"), F.col("__sha").alias("sha"))
    repeated = not held.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    stay = marked.where(mine)
    if repeated:
        stay = stay.dropDuplicates([id_col, "__sha"])
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
