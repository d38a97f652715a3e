"""Similarity join on word n-gram sets: size-banded tiles, bitmap bounds, exact intersections.

1. Each text becomes a sorted array of 64-bit hashes of its distinct five-word shingles, and a digest of that array;
   texts with the same set are one node.
2. Two sets of Jaccard similarity t or more share one of the first ``p`` = n - ceil(t * n) + 1 elements of either, in
   any order of elements that all sets use.  The order is by the number of sets an element is in: elements of one set
   alone come first and lead nowhere, so a set with ``p`` of them has no partner, and passages that many texts share
   come last.  To count, each set sends the elements below a fixed hash bound, which come before the others in the
   order, or all its elements if fewer than ``p`` lie below.
3. In each task, and then over the tasks, the sets that hold a prefix element are tied to the least of them, so that
   an element in very many sets puts few rows in one place.  Each set is first compared with the least set it is tied
   to, in tiles of one such hub and a bounded number of others.  This links copies to each other by way of their hubs.
4. What ties still lead from one linked group to another make families of groups.  In a family the sets are banded by
   size, so that partners lie in one band or in neighbouring ones, bands are cut into blocks, and pairs of blocks make
   tiles of bounded size; the family's largest group isn't paired with itself.  Within a tile, a hashed bitmap of each
   set gives an upper bound of the overlap by counting bits, and pairs that pass are intersected exactly, as sorted
   arrays.  Sets already linked are not compared again.

Nothing is sampled or capped: elements so frequent that their rows would make one task large (at most HOT_SHARE of
them) are known to all tasks and skip the counting, being last in the order anyway.

Defined cases: a null or empty text has the empty set, is linked with nothing and is its own component, as is a null
doc_id.  Texts of fewer than five words have one shingle, the whole sequence.  Repeated rows are linked, having the same
set; where one doc_id comes with several texts, each row has the component of its own text.  An empty table gives an
empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import BROADCAST_ROWS, look_up, materialise, short_batches, small
from quadrille.llm.components import connected

WORDS, PERCENT = 5, 80
#: Share of the hash range that comes first; so much over the prefix's share of a set that few sets need the rest.
COUNTED = 0.28
#: Sets, and elements of all its sets, that a block has at most, about; a tile has two blocks.
BLOCK, BLOCK_ELEMENTS = 600, 1_500_000
#: An element in at least one of HOT_SHARE counted rows is hot.
HOT_SHARE = 2048

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
#: An odd multiplier and its inverse modulo 2 ** 64.
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 2**64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x + _MIX[0]).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def shingle_hashes(text: bytes, seed: int = 0, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = np.frombuffer(text, np.uint8)
    word = ~_GAP[raw]
    if not word.any():
        return np.empty(0, np.uint64)
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = _mixed(_LOWER[raw] + np.uint64(seed) * np.uint64(256))
    up, down = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
    running = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:-1], dtype=np.uint64)])
    hashed = _mixed((running[end] - running[start]) * down[start] + _mixed((end - start).astype(np.uint64)))
    width = min(words, len(hashed))
    out = np.zeros(len(hashed) - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out) ^ hashed[k : len(hashed) - width + 1 + k]
    return np.unique(_mixed(out + np.uint64(width)))


def prefix_length(n, percent: int = PERCENT):
    """Of sets of n elements, how many first ones include one of any partner's."""
    return n - (n * percent + 99) // 100 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """id, n, digest, node, below, elements: below counts the elements under the bound, elements are those that are sent.

    A task sends the elements of a set once, so copies of a text add nothing.
    """
    bound = np.uint64(int(COUNTED * 2**64))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in short_batches(batches):
            sizes, digests, nodes, below, elements = [], [], [], [], []
            for text in batch.column(text_col).cast(pa.binary()).to_pylist():
                have = shingle_hashes(text or b"", seed)
                digest = blake2b(have.tobytes(), digest_size=16).digest()
                low = int(np.searchsorted(have, bound))
                sizes.append(len(have))
                digests.append(digest if len(have) else None)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                below.append(low)
                if digest in sent or not len(have):
                    elements.append(None)
                    continue
                if len(sent) >= 500_000:
                    sent.clear()
                sent.add(digest)
                elements.append((have[:low].copy() if low >= prefix_length(len(have)) else have).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(below, pa.int64()), pa.array(elements, pa.list_(pa.int64()))],
                ["id", "n", "digest", "node", "below", "elements"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(make, f"id {kind}, n long, digest binary, node long, below long, elements array<long>")


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (element, node, n, below, above) of a partition with whole elements: those in two sets or more, with their number of sets."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    element, node = table["element"].to_numpy(), table["node"].to_numpy()
    order = np.lexsort((node, element))
    element, node = element[order], node[order]
    once = _changes(element) | _changes(node)  # a node comes from several tasks
    order, element = order[once], element[once]
    starts = np.flatnonzero(_changes(element))
    sets = np.diff(np.concatenate([starts, [len(element)]]))
    sets = np.repeat(sets, sets)
    out = table.take(pa.array(order[sets > 1])).append_column("sets", pa.array(sets[sets > 1], pa.int64()))
    yield from out.combine_chunks().to_batches(max_chunksize=20_000)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _ties(element: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (node, least node with the same element), and each element with its least node."""
    order = np.lexsort((node, element))
    element, node = element[order], node[order]
    starts = np.flatnonzero(_changes(element))
    hub = np.repeat(node[starts], np.diff(np.concatenate([starts, [len(element)]])))
    order = np.lexsort((hub, node))
    order = order[node[order] != hub[order]]
    member, least = node[order], hub[order]
    once = _changes(member) | _changes(least)
    return member[once], least[once], element[starts], node[starts]


def _cut_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole nodes, those rows whose element is in the node's prefix, as ties within the task.

    Rows are (node, hub) for a node and the least one that shares an element with it, and (element, node) for the least
    node of each element.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    node, element, above = table["node"].to_numpy(), table["element"].to_numpy(), table["above"].to_numpy()
    n, below, sets = table["n"].to_numpy(), table["below"].to_numpy(), table["sets"].to_numpy()
    order = np.lexsort((element, sets, above, node))
    node, element, above, n, below = node[order], element[order], above[order], n[order], below[order]
    once = _changes(node) | _changes(element)  # hot elements come from several tasks
    node, element, above, n, below = node[once], element[once], above[once], n[once], below[once]
    # Places in the order: elements of this set only come first among those below the bound, and among those above it.
    new = _changes(node) | _changes(above)
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    shared = np.diff(np.concatenate([starts, [len(node)]]))[group]
    place = np.where(above, n, below) - shared + np.arange(len(node)) - starts[group]
    stay = place < prefix_length(n)
    members, hubs, elements, least = _ties(element[stay], node[stay])
    none = lambda k: pa.nulls(k, pa.int64())
    if len(elements):
        yield pa.RecordBatch.from_arrays([none(len(members)), pa.array(members), pa.array(hubs)], ["element", "node", "hub"])
        yield pa.RecordBatch.from_arrays([pa.array(elements), pa.array(least), none(len(least))], ["element", "node", "hub"])


def _tie_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (element, node), all those of an element in one partition, as ties (node, hub)."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        members, hubs, _, _ = _ties(table["element"].to_numpy(), table["node"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(hubs)], ["node", "hub"])


def _mapped(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the sets by size, their sizes and their hashed bitmaps."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    bits = 64 << max(0, math.ceil(math.log2(max(1, n[-1] / 64))))
    words = bits // 64
    maps = np.zeros((len(order), words), np.uint64)
    for k, at in enumerate(order):
        low = sets[at] % np.uint64(bits)
        np.bitwise_or.at(maps[k], (low >> np.uint64(6)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return order, n, maps


def _within_bound(n: np.ndarray, maps: np.ndarray, k: int, near: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``near`` that share enough with set k as far as their bitmaps tell, and the least overlap of partners."""
    need = -(-(n[near] + n[k]) * percent // (100 + percent))
    mine, theirs = maps[k], maps[near]
    most = np.minimum(n[k] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[near] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
    return near[most >= need], need[most >= need]


def _link(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose sets are linked, enough to join all parts that any pair links.

    part: sets with the same number are linked already.  side: 0 or 1; pairs are compared across sides only, if given.
    """
    order, n, maps = _mapped(sets)
    part = part[order].copy()
    across = None if side is None else side[order]
    links = []
    for k in range(1, len(order)):
        low = int(np.searchsorted(n, -(-n[k] * percent // 100)))  # smaller sets can't reach the similarity
        if low >= k:
            continue
        near = np.arange(low, k)
        near = near[part[near] != part[k]]
        if across is not None:
            near = near[across[near] != across[k]]
        if not len(near):
            continue
        for other, least in zip(*_within_bound(n, maps, k, near, percent), strict=True):
            if part[other] == part[k]:
                continue
            both = len(np.intersect1d(sets[order[k]], sets[order[other]], assume_unique=True))
            if both >= least and 100 * both >= percent * (n[k] + n[other] - both):
                links.append((int(order[k]), int(order[other])))
                part[part == part[k]] = part[other]
    return links


def _count_links(sets: list[np.ndarray], rows: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set the rows of all sets that it is linked with, across sides only, if given."""
    order, n, maps = _mapped(sets)
    rows = rows[order]
    across = None if side is None else side[order]
    # Each set as the sorted ranks of its elements, so that a set is intersected with many at once.
    elements, ranks = np.unique(np.concatenate([sets[at] for at in order]), return_inverse=True)
    ranks = np.split(ranks, np.cumsum(n)[:-1])
    mine = np.zeros(len(elements), bool)
    found = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        near = np.arange(int(np.searchsorted(n, -(-n[k] * percent // 100))), k)
        if across is not None:
            near = near[across[near] != across[k]]
        near, need = _within_bound(n, maps, k, near, percent)
        if not len(near):
            continue
        mine[ranks[k]] = True
        both = np.add.reduceat(mine[np.concatenate([ranks[x] for x in near])], np.cumsum(n[near]) - n[near], dtype=np.int64)
        mine[ranks[k]] = False
        linked = near[(both >= need) & (100 * both >= percent * (n[k] + n[near] - both))]
        found[k] += rows[linked].sum()
        found[linked] += rows[k]
    out = np.empty(len(order), np.int64)
    out[order] = found
    return out


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between the groups of a tile; the sides of a tile between two blocks differ, those inside a block are null."""
    group, side = table["group"].to_numpy(), table["side"]
    sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
    links = _link(sets, np.unique(group, return_inverse=True)[1], None if side.null_count else side.to_numpy(), PERCENT) if len(sets) > 1 else []
    return pa.table({"a": pa.array([group[x] for x, _ in links], pa.int64()), "b": pa.array([group[y] for _, y in links], pa.int64())})


def _count_tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The rows that each set of a tile is linked with in it."""
    table = table.take(pa.array(np.unique(table["group"].to_numpy(), return_index=True)[1]))  # rows with one doc_id and one set bring it twice
    side = table["side"]
    sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
    links = _count_links(sets, table["rows"].to_numpy(), None if side.null_count else side.to_numpy(), PERCENT)
    return pa.table({"group": table["group"], "links": pa.array(links)}).filter(pa.array(links > 0))


def _in_tiles(docs: DataFrame, tiles: DataFrame, seed: int) -> DataFrame:
    """The sets of each tile, made from the texts again, of a written table node, id, tiles (array of tile and side) and other numbers."""
    carried = [c for c in tiles.columns if c not in ("node", "id", "tiles")]

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short_batches(batches):
            elements = [shingle_hashes(t or b"", seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            own = np.array([int.from_bytes(blake2b(x.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for x in elements], np.int64)
            good = pa.array(own == batch.column("node").to_numpy())  # of rows that share a doc_id, the one with this set
            columns = [*[batch.column(c) for c in carried], batch.column("tiles"), pa.array([x.tobytes() for x in elements], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "tiles", "elements"]).filter(good)

    texts = docs.select(F.col("doc_id").alias("id"), "text")
    places = tiles.agg(F.sum(F.size("tiles"))).first()[0] or 0
    joined = texts.join(F.broadcast(tiles) if places <= BROADCAST_ROWS else tiles, "id").select("text", "node", *carried, "tiles")
    held = joined.mapInArrow(again, "".join(f"{c} long, " for c in carried) + "tiles array<struct<tile:string,side:int>>, elements binary")
    return held.select(*carried, "elements", F.explode("tiles").alias("t")).select(*carried, "elements", "t.tile", "t.side")


def _linked_in_tiles(docs: DataFrame, tiles: DataFrame, seed: int) -> DataFrame:
    """Links a, b between groups, of a written table node, id, group, tiles."""
    return _in_tiles(docs, tiles, seed).groupBy("tile").applyInArrow(_tile, "a long, b long").distinct()


def _ties_of(found: DataFrame) -> DataFrame:
    """node, hub: ties that join all nodes which share a prefix element; the hub is the smaller node."""
    sets = found.select(F.explode("elements").alias("element"), "node", "n", "below")
    bound = int(COUNTED * 2**64)
    # Elements are unsigned numbers held as signed ones.
    above = (F.col("element") < 0) | (F.col("element") >= bound) if bound < 2**63 else (F.col("element") < 0) & (F.col("element") >= bound - 2**64)
    sets = sets.select("element", "node", "n", "below", above.alias("above"))
    often = sets.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(element, {HOT_SHARE}, {HOT_SHARE * 16})").alias("top")).first()
    hot = [x["item"] for x in often["top"] or [] if x["count"] >= max(2, often["rows"] // HOT_SHARE)]  # HOT_SHARE at most
    known = F.col("element").isin(hot)
    counted = sets.where(~known).repartition("element").mapInArrow(_count_elements, "element long, node long, n long, below long, above boolean, sets long")
    last = sets.where(known).withColumn("sets", F.lit(2**62))
    keys = materialise(counted.unionByName(last).repartition("node").mapInArrow(_cut_prefixes, "element long, node long, hub long"), "prefixes")
    over = keys.where("hub IS NULL").select("element", "node").repartition("element").mapInArrow(_tie_tasks, "node long, hub long")
    return keys.where("hub IS NOT NULL").select("node", "hub").unionByName(over).distinct()


def _blocks(sets, elements):
    return F.ceil(F.greatest(sets / BLOCK, elements / BLOCK_ELEMENTS)).cast("long")


def _star_tiles(ties: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tiles of each node with the least one that it is tied to, as node, id, group, tiles; every node is a group."""
    stars = materialise(ties.groupBy("node").agg(F.min("hub").alias("hub")).join(nodes.select("node", "n"), "node"), "stars")
    hubs = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"), _blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    large = materialise(hubs.where("blocks > 1"), "hubs")
    tile = F.concat_ws(":", "hub", F.pmod(F.xxhash64("node"), F.coalesce(F.col("blocks"), F.lit(1).cast("long"))))
    placed = look_up(stars, "hub", large, "sets", stars.count(), "node").select("node", "hub", tile.alias("tile"))
    every = placed.select("node", "tile", F.lit(1).alias("side")).unionByName(placed.select(F.col("hub").alias("node"), "tile", F.lit(0).alias("side")).distinct())
    return every.groupBy("node").agg(F.collect_list(F.struct("tile", "side")).alias("tiles")).join(nodes, "node").select("node", "id", F.col("node").alias("group"), "tiles")


def _family_tiles(ties: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tiles for ties between groups, as node, id, group, tiles.  ties: written, with the number of ties; nodes: node, id, n, group, written."""
    total = nodes.count()
    group = nodes.select("node", "group")
    first = ties.join(group.withColumnRenamed("group", "own"), "node")
    hubs = ties.groupBy("hub").agg(F.count(F.lit(1)).alias("ties")).join(group.select(F.col("node").alias("hub"), F.col("group").alias("other")), "hub")
    across = look_up(first, "hub", materialise(hubs, "hubs"), "ties", ties.count(), "node").where("own <> other")
    families = connected(across.select(F.col("own").alias("a"), F.col("other").alias("b")))
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("sets"))
    families = materialise(families.select(F.col("node").alias("group"), F.col("label").alias("family")).join(sizes, "group"), "families")
    main = families.groupBy("family").agg(F.max(F.struct("sets", "group")).alias("x")).select("family", F.col("x.group").alias("main"))
    families = materialise(families.join(main, "family"), "families")
    held = look_up(nodes, "group", families, "sets", total, "node").where("family IS NOT NULL")
    # A class is a band of the main group or of the others.
    held = materialise(held.select("node", "id", "n", "group", "family", (2 * _band() + (F.col("group") == F.col("main")).cast("long")).alias("class")), "families")
    return _banded_tiles(held, total).select("node", "id", "group", "tiles")


def _component_tiles(nodes: DataFrame) -> DataFrame:
    """Tiles in which all sets of a component meet that can be partners, as node, id, group, rows, tiles; every node is a group."""
    total = nodes.count()
    sizes = materialise(nodes.groupBy("group").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "sizes")
    held = look_up(nodes, "group", sizes, "sets", total, "node").where("sets IS NOT NULL")
    held = materialise(held.select("node", "id", "n", "rows", F.col("group").alias("family"), (2 * _band()).alias("class")), "families")
    return _banded_tiles(held, total).select("node", "id", F.col("node").alias("group"), "rows", "tiles")


def _band():
    """Sizes s and s * 100 / PERCENT are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) + 1e-9)


def _banded_tiles(held: DataFrame, total: int) -> DataFrame:
    """A written table of nodes with family and class, with their tiles.  Two blocks of odd class aren't paired.  total: at least its rows."""
    classes = held.groupBy("family", "class").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements"))
    plan = classes.groupBy("family").agg(
        F.map_from_entries(F.collect_list(F.struct("class", _blocks(F.col("sets"), F.col("elements"))))).alias("blocks"),  # as many as bands, twice
        F.sum("sets").alias("sets"),
        ((F.sum("sets") <= BLOCK) & (F.sum("elements") <= BLOCK_ELEMENTS)).alias("whole"),
    )
    placed = look_up(held, "family", materialise(plan, "plan"), "sets", total, "node")
    own = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce(F.col("blocks")[F.col("class")], F.lit(1).cast("long"))))
    me = F.struct(F.col("class").alias("class"), F.col("block").alias("block"))

    def with_class(k):
        blocks = F.coalesce(F.col("blocks")[k], F.lit(0).cast("long"))
        both_main = (F.col("class") % 2 == 1) & (k % 2 == 1)
        each = F.when((blocks > 0) & ~both_main, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(each, lambda j: F.struct(k.alias("class"), j.alias("block")))

    def tile(x):
        name = lambda s: F.concat_ws(":", s["class"], s["block"])
        side = F.when(x == me, F.lit(None)).when(me < x, 0).otherwise(1).cast("int")
        return F.struct(F.concat_ws(":", "family", name(F.least(x, me)), name(F.greatest(x, me))).alias("tile"), side.alias("side"))

    start = 2 * F.floor(F.col("class") / 2) - 2
    partners = F.flatten(F.transform(F.sequence(start, start + 5), with_class))
    alone = F.array(F.struct(F.col("family").cast("string").alias("tile"), F.lit(None).cast("int").alias("side")))
    return own.withColumn("tiles", F.when(F.col("whole"), alone).otherwise(F.transform(partners, tile)))


def _grouped(nodes: DataFrame, labels: DataFrame, by: str = "node") -> DataFrame:
    """nodes with group: the label of column ``by``, or else itself."""
    return nodes.join(labels.select(F.col("node").alias(by), "label"), by, "left").withColumn("group", F.coalesce("label", by)).drop("label")


def _groups(docs: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """node, id, n, rows, group of every node; groups are the connected components of the links."""
    sets = found.where("n > 0")
    nodes = materialise(sets.groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "nodes")
    ties = materialise(_ties_of(found.where("elements IS NOT NULL")), "ties")
    stars = connected(materialise(_linked_in_tiles(docs, materialise(_star_tiles(ties, nodes), "tiles"), seed), "links"))
    nodes = materialise(_grouped(nodes, stars), "nodes")
    links = materialise(_linked_in_tiles(docs, materialise(_family_tiles(ties, nodes), "tiles"), seed), "links")
    labels = materialise(connected(links), "labels")
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("sets"))
    final = materialise(sizes.join(labels.withColumnRenamed("node", "group"), "group"), "labels")
    return look_up(nodes, "group", final, "sets", nodes.count(), "node").select("node", "id", "n", "rows", F.coalesce("label", "group").alias("group"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; with ``count_links`` also n_links, the number of other rows linked with it.

    A component alone says how its rows hang together, and takes few comparisons.  To count links, all sets of a component
    that their sizes and bitmaps don't tell apart are intersected, in tiles of bounded size, the number of which grows with
    the square of the number of different sets in the component.  Tiles return counts, not pairs.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        found = materialise(_sets(docs, "doc_id", "text", seed), "sets")
        kinds = found.where("n > 0").groupBy("node").agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
        if kinds.where("x <> y").isEmpty():
            break
        seed += 1  # two sets share the 64 bits that name a node
    nodes = materialise(_groups(docs, found, seed), "nodes")
    least = nodes.groupBy("group").agg(F.min("id").alias("component"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("sets")).where("all > 1")
    # Nodes alone in their component, with one row, need no look-up.
    held = look_up(nodes, "group", materialise(least, "components"), "sets", nodes.count(), "node").where("all > 1")
    if count_links:
        tiles = materialise(_component_tiles(nodes), "tiles")
        counts = _in_tiles(docs, tiles, seed).groupBy("tile").applyInArrow(_count_tile, "group long, links long")
        counts = materialise(counts.groupBy(F.col("group").alias("node")).agg(F.sum("links").alias("links")), "counts")
        held = held.join(counts, "node", "left")
    else:
        held = held.withColumn("links", F.lit(0).cast("long"))
    links = (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    table = materialise(held.select(F.col("node").alias("key"), "rows", "component", links), "components")
    total = found.count()
    keyed = found.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("key"))
    joined = look_up(keyed.where("n > 0"), "key", table, "rows", total, "id")
    named = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")]
    out = joined.select(*named, F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    out = out.unionByName(keyed.where("n = 0").select(*named, F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return out if count_links else out.drop("n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component, those whose doc_id is its smallest.

    Run exact dedup first: rows that repeat the kept id all stay.  If rows share a doc_id but not the text, all go with
    the first that goes.
    """
    found = components(docs, id_col, text_col)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(small(gone), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
