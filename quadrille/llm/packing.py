"""Packing of documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a remainder.  The lengths of the pieces are counted in a histogram
(``step`` tokens a bin, rounded up).  A linear program over patterns, each of which says how many pieces of each bin
share a sequence, is solved by column generation: a knapsack dynamic program over the program's dual prices finds the
next pattern.  The solution is rounded down, the few pieces left over are packed best-fit, and pieces are assigned to
patterns by their rank in their bin; pieces that fill a sequence need no rank and get one each.  The histogram, and so the program, is bounded by the sequence length, whatever
the corpus.

Defined cases: a null or empty text is the end id alone.  Rows with the same doc_id are packed as documents of their
own.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import materialise, short_batches, small
from quadrille.llm.tokens import encoder

CAPACITY, STEP, END_ID = 4096, 16, 2
#: Pieces of a bin that are ranked together, about: a bin is dealt out over as many parts as it takes.
RANKED_ROWS = 1000


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, by_chunk: bool = True, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, with ``keep_ids``, ids (little-endian 32-bit numbers) of every piece."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shipped.value, by_chunk)
        for batch in short_batches(batches):
            at, start, length, crc, tokens, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                whole = encode(text or "") + end
                n = len(whole) // 4
                for s in range(0, n, capacity):
                    part = whole[4 * s : 4 * (s + capacity)]
                    at.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
                    if keep_ids:
                        ids.append(part)
            columns = [batch.column(id_col).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)), *([pa.array(ids, pa.binary())] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])])

    return docs.select(id_col, text_col).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern of the highest total price."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        value[c], last[c] = value[c - 1], -1
        if n := fits[c]:
            sums = prices[:n] + value[c - sizes[:n]]
            best = int(sums.argmax())
            if sums[best] > value[c] + 1e-12:
                value[c], last[c] = sums[best], best
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(value[room]), pattern


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, without the threads of a linear algebra library, which can stall a busy driver."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        work -= np.multiply.outer(others, work[k])
    return work[:, n:]


def cutting_stock(demand: dict[int, int], room: int, gap: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns with their number of copies, which together hold ``demand`` (size: number) exactly.

    The linear program is solved to within ``gap`` of its optimum, or until it no longer improves; rounding leaves at most one sequence for each size,
    and the pieces in them are packed best-fit, longest first.
    """
    sizes = np.array(sorted(demand), np.int64)
    need = np.array([demand[s] for s in sizes.tolist()], float)
    m = len(sizes)
    out: list[tuple[dict[int, int], int]] = []
    left = need.astype(np.int64)
    if m:
        basis = np.diag(room // sizes).astype(float)
        inverse, amount = np.diag(1 / np.diag(basis)), need / np.diag(basis)
        best, since = np.inf, 0
        for turn in range(1, 100 * m + 1000):
            # Ties can make the simplex go round without gain; any basis is a packing, so it ends there.
            since = 0 if amount.sum() < best * (1 - 1e-6) else since + 1
            best = min(best, amount.sum())
            if since > 100:
                break
            prices = inverse.sum(0)
            value, pattern = _best_pattern(sizes, np.maximum(prices, 0), room)
            if value <= 1 + gap:
                break
            used = np.flatnonzero(pattern)
            entering = (inverse[:, used] * pattern[used]).sum(1)  # a few columns: no work for many threads
            grows = entering > 1e-10
            ratio = np.full(m, np.inf)
            ratio[grows] = amount[grows] / entering[grows]
            row = int(ratio.argmin())
            theta = ratio[row]
            amount = amount - theta * entering
            amount[row] = theta
            amount[amount < 0] = 0
            basis[:, row] = pattern
            inverse[row] /= entering[row]
            others = entering.copy()
            others[row] = 0
            inverse -= np.outer(others, inverse[row])
            if turn % 200 == 0:  # keep rounding errors small
                inverse = _inverted(basis)
                amount = np.maximum((inverse * need).sum(1), 0)
        for column, copies in zip(basis.T.astype(np.int64), np.floor(amount + 1e-9).astype(np.int64), strict=True):
            copies = int(min([copies, *(left[column > 0] // column[column > 0])]))
            if copies > 0:
                left -= copies * column
                out.append(({int(sizes[k]): int(column[k]) for k in np.flatnonzero(column)}, copies))
    return out + [(dict(p), n) for p, n in Counter(_best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, room)).items()]


def _best_fit(left: dict[int, int], room: int) -> list[tuple[tuple[int, int], ...]]:
    """Sequences, each as sorted (size, number) pairs."""
    free: list[tuple[int, int]] = []
    held: list[Counter] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            k = bisect.bisect_left(free, (size, -1))
            if k < len(free):
                rest, at = free.pop(k)
            else:
                rest, at = room, len(held)
                held.append(Counter())
            held[at][size] += 1
            bisect.insort(free, (rest - size, at))
    return [tuple(sorted(x.items())) for x in held]


def assign(cut: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """The rows of a written table of pieces with sequence_id and offset."""
    spark = cut.sparkSession
    binned = cut.withColumn("__bin", F.ceil(F.col("length") / step).cast("long"))
    room = -(-capacity // step)
    demand = {r[0]: r[1] for r in binned.where(F.col("__bin") < room).groupBy("__bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    intervals: dict[int, list[tuple[int, int, int, int]]] = {b: [] for b in demand}
    done, sequences = Counter(), 0
    for pattern, copies in cutting_stock(demand, room):
        for b, per_copy in pattern.items():
            intervals[b].append((done[b], done[b] + per_copy * copies, per_copy, sequences))
            done[b] += per_copy * copies
        sequences += copies
    shape = "__bin long, __salts long, __spans array<struct<low:long,high:long,each:long,first:long>>"
    # As many rows as bins, which the sequence length bounds.
    table = F.broadcast(spark.createDataFrame([(b, -(-n // RANKED_ROWS), intervals[b]) for b, n in demand.items()], shape))
    alone = binned.where(F.col("__bin") >= room).select(*cut.columns, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    known = binned.where(F.col("__bin") < room).join(table, "__bin")
    salted = known.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("__salts")))
    counts = salted.groupBy("__bin", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__bin", "__salt", (F.sum("n").over(Window.partitionBy("__bin").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(Window.partitionBy("__bin", "__salt").orderBy("doc_id", "start", "ids_crc32")))
    joined = ranked.join(small(materialise(before, "salts")), ["__bin", "__salt"])
    joined = joined.withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    joined = joined.withColumn("__span", F.filter("__spans", lambda x: (x.low <= F.col("__rank")) & (F.col("__rank") < x.high))[0])
    placed = joined.withColumn("sequence_id", F.col("__span.first") + F.floor((F.col("__rank") - F.col("__span.low")) / F.col("__span.each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("__bin"), "__rank")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*cut.columns, "sequence_id", "offset").unionByName(alone)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID, by_chunk: bool = True, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    return assign(materialise(pieces(docs, tokenizer_json, capacity, end_id, by_chunk, keep_ids, id_col, text_col), "pieces"), capacity, step)
