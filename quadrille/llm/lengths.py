"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are encoded whole and counted by their number of tokens.  Suffix sums over the histogram give, at each length
L that occurs: documents and tokens at or above L, and the total when every document is cut to L tokens.  Between two
lengths these are linear, so the table answers every limit: with a limit C, take the first length L >= C; then
total(C) = truncated_total - (L - C) * docs_at_least.

The sums are made in two levels, within blocks of lengths and over the blocks, so that no task sees all lengths.

Defined cases: a null or empty text has 0 tokens (with ``end_id``, 1) and counts.  Repeated rows count each.  An empty
table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import materialise, short_batches
from quadrille.llm.tokens import encoder

#: Lengths in a block.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer_path: str, by_chunk: bool = True, extra: int = 0, text_col: str = "text") -> DataFrame:
    """length, n_docs.  ``extra`` tokens are added to each document."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped.value, by_chunk)
        for batch in short_batches(batches):
            sizes = [len(encode(t or "")) // 4 + extra for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["length"])

    return docs.select(text_col).mapInArrow(count, "length long").groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(hist: DataFrame) -> DataFrame:
    """Per length: length, n_docs, docs_at_least, tokens_at_least, truncated_total, quantile (share of documents up to this length)."""
    hist = materialise(hist.withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    tokens = F.col("length") * F.col("n_docs")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length"))
    joined = hist.join(blocks, "block")
    docs = F.col("docs_above") + F.sum("n_docs").over(down)
    there = F.col("tokens_above") + F.sum(tokens).over(down)
    return joined.select("length", "n_docs", docs.alias("docs_at_least"), there.alias("tokens_at_least"), "all_docs", "all_tokens").select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def quantile(totals: DataFrame, share: float) -> DataFrame:
    """length: the least one that at least ``share`` of the documents don't exceed."""
    return totals.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))


def truncated_total(totals: DataFrame, limit: int) -> DataFrame:
    """total: the corpus's tokens if every document is cut to ``limit``."""
    up = totals.where(F.col("length") >= limit).agg(F.min(F.struct("length", "truncated_total", "docs_at_least")).alias("x"))
    every = totals.agg(F.max("truncated_total").alias("all"))
    return up.join(every).select(F.coalesce(F.col("x.truncated_total") - (F.col("x.length") - limit) * F.col("x.docs_at_least"), F.col("all"), F.lit(0)).alias("total"))
