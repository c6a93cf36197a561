"""Exact Jaccard join of texts' word-shingle sets, with signature trees.

1. Texts with equal sets are one class; everything after works on classes, so copies of a text cost nothing more.
2. Shingles have one global order: rare ones by hash, then the frequent ones by count. Sets that link share several shingles
   among the first of both (prefix filter), so classes that share such a shingle meet in a bucket, and a class that shares
   too few of them with others goes.
3. In each bucket, classes stand in signature trees: a leaf holds some classes, a node the OR of their bitmaps and their
   range of set sizes. Two trees are walked together; a pair of nodes is dropped when sizes or shared bits leave no
   possible link. Large buckets are cut into tiles, and each pair of tiles is a group of its own.
4. A bucket first gives a spanning forest of its possible links, the likeliest first: no more pairs than classes. They are
   verified on the sets, and linked classes get one label. Buckets whose classes have one label are settled; the others
   give every possible link between different labels, and these are verified too.
5. Components of the verified links follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import broadcast_if_small, ship_package, text_batches, written
from panelforge.llm.components import components
from panelforge.llm.shingles import set_digest, shingle_sets

#: Documents of a task are counted in lots of so many shingles; a task reports at most TASK_FREQUENT shingles.
LOT, TASK_FREQUENT, MOST_FREQUENT = 4_000_000, 20_000, 50_000
#: Bits of a signature for each shingle, classes of a leaf, children of a node, classes of a tile.
BITS, LEAF, FAN, TILE = 2, 8, 8, 512
#: A class brings so many of its keys into a bucket; a pair that shares none of them may come from several buckets.
FIRSTS = 64
SPLIT_BYTES = 1 << 20


def needed(n: int, percent: int) -> int:
    """Shingles that a set of size n shares at least with any set it links to."""
    return -(-percent * n // 100)


#: Share of a set, in percent, by which its prefix is longer than one common shingle needs.
EXTRA = 5


def least_common(n: int) -> int:
    """Shingles that two linked sets of at least n shingles share among the first of both: their prefixes are so much longer."""
    return 1 + EXTRA * n // 100


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have a Jaccard similarity of at least ``percent`` / 100."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _classes(k: int):
    """Rows (id, text's hash, node, n, NULL) for texts, then one of the task with its frequent shingles and their counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size, found = 0, []

        def count():
            nonlocal size
            if held:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                found.append((h[c >= 3], c[c >= 3]))
                held.clear()
                size = 0
            if len(found) > 4:
                found[:] = [_top(found)]

        for batch in text_batches(it, "text", SPLIT_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            nodes = [set_digest(s) if len(s) else None for s in sets]
            for node, s in zip(nodes, sets):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
            if size >= LOT:
                count()
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), sizes, pa.nulls(len(sets), pa.binary())], names=_CLASS_NAMES)
        count()
        h, c = _top(found)
        if len(h):
            data = np.stack([h, c.astype(np.uint64)]).tobytes()
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([data], pa.binary())], names=_CLASS_NAMES)

    return run


_CLASS_NAMES = ["id", "hash", "node", "n", "frequent"]


def _top(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    c = np.bincount(back, np.concatenate([f[1] for f in found]), len(h)).astype(np.int64)
    best = np.lexsort((h, -c))[:TASK_FREQUENT]
    return h[best], c[best]


def _unpack_frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for data in batch.column(0).to_pylist():
            h, c = np.frombuffer(data, np.uint64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])


def _prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the global order: a link shares at least ``least_common`` of them.

    Sets x and y that share o shingles have k common ones among the first |x| - o + k of x and |y| - o + k of y.
    """
    size = min(len(s), len(s) - needed(len(s), percent) + least_common(len(s)))
    if not len(frequent):
        return s[:size]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    common = frequent[at] == s
    rare = s[~common]
    if len(rare) >= size:
        return rare[:size]
    late = s[common][np.argsort(rank[at[common]])]
    return np.concatenate([rare, late[: size - len(rare)]])


def _prefix_rows(k: int, percent: int, shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        seen: set[int] = set()
        for batch in text_batches(it, "text", SPLIT_BYTES):
            nodes, keys, sizes = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), k):
                node = set_digest(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(s))
                    keys.append(_prefix(s, frequent, rank, percent))
            if nodes:
                lens = np.fromiter(map(len, keys), np.int64, len(keys))
                cols = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), lens), np.repeat(np.array(sizes, np.int32), lens)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n"])

    return run


def _set_rows(k: int):
    """(node, hashes, bits) for rows (node, text); a task gives a class once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_batches(it, "text", SPLIT_BYTES):
            own = []
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k)):
                # Another text may share the id and the hash by which this one was found.
                if node not in seen and set_digest(s) == node:
                    seen.add(node)
                    own.append((node, s.tobytes(), signature(s).tobytes()))
            cols = [[x[i] for x in own] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()))], names=["node", "hashes", "bits"])

    return run


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set's hashes; its length is a power of two of at least BITS bits for each shingle."""
    width = 1 << max(6, int(BITS * len(s) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _against_first(percent: int):
    """Links (a, b) among rows (a, part, first, node, hashes) that come by part, the row of ``a`` itself first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, against = None, None
        for batch in it:
            found = []
            for a, salt, first, node, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, salt) != part:
                    part, against = (a, salt), None
                if first:
                    against = np.frombuffer(hashes, np.uint64)
                elif against is not None and links(np.frombuffer(hashes, np.uint64), against, percent):
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table that are links. The set of ``a`` meets all its partners at once, in parts of TILE."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("_parts"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(True).alias("first"), F.col("a").alias("node"))
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part"), F.lit(False).alias("first"), F.col("b").alias("node"))
    rows = broadcast_if_small(written(own.unionAll(others), "join-meetings"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sets.select("node", "hashes").join(rows, "node").select("a", "part", "first", "node", "hashes")
    ordered = met.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.desc("first"))
    return ordered.mapInArrow(_against_first(percent), "a long, b long").distinct()


class Tree:
    """Signature tree over classes in the order of their set sizes. Levels run from classes to the root."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.order, n, b = order, sizes[order], bits[order]
        # Shingles that share a bit with another one of their set may be shared without showing.
        hidden = n - np.bitwise_count(b).sum(1).astype(np.int64)
        self.levels = [(n, n, b, hidden)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            lo, hi, b, hidden = self.levels[-1]
            at = np.arange(0, len(lo), fan)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.bitwise_or.reduceat(b, at), np.maximum.reduceat(hidden, at)))
            fan = FAN

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, child) for each child one level below."""
        fan = LEAF if level == 1 else FAN
        first = nodes * fan
        count = np.minimum(len(self.levels[level - 1][0]) - first, fan)
        return np.repeat(np.arange(len(nodes)), count), np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def walk(x: Tree, y: Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes (places in the order of the trees) that sizes and bitmaps leave possible; ``same``: a tree with itself, each pair once."""
    i, j = len(x.levels) - 1, len(y.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(x.levels[i], y.levels[j], a, b, percent)
        if same:
            keep &= (a < b) if i == 0 else (a <= b)
        a, b = a[keep], b[keep]
        if (i == 0 and j == 0) or not len(a):
            return a, b
        if same:
            at, a2 = x.children(i, a)
            at2, b2 = y.children(j, b[at])
            a, b, i, j = a2[at2], b2, i - 1, j - 1
        elif i >= j:
            at, a = x.children(i, a)
            b, i = b[at], i - 1
        else:
            at, b = y.children(j, b)
            a, j = a[at], j - 1


def _possible(x, y, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair of nodes can hold a link: size ranges, then the most shingles that common bits allow."""
    (lo, hi, bits, hidden), (lo2, hi2, bits2, hidden2) = x, y
    keep = (100 * hi[a] >= percent * lo2[b]) & (100 * hi2[b] >= percent * lo[a])
    at = np.flatnonzero(keep)
    for k in range(0, len(at), 4096):
        own = at[k : k + 4096]
        p, q = a[own], b[own]
        common = np.bitwise_count(bits[p] & bits2[q]).sum(1).astype(np.int64)
        most = common + np.minimum(hidden[p], hidden2[q])
        keep[own] = (100 + percent) * most >= percent * (lo[p] + lo2[q])
    return keep


def bucket_pairs(
    key: int, nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, tiles: np.ndarray, bits: list[bytes], firsts: list[list[int]], percent: int, forest: bool
) -> list[tuple[int, int]]:
    """Possible links of a bucket between classes of different labels; ``forest``: only a spanning forest, likeliest first.

    With two tiles, only pairs across them. ``firsts`` are the smallest keys of each class's open buckets: a pair that
    shares a smaller key is left to that bucket.
    """
    widths = np.array([len(b) for b in bits])
    out: list[tuple[float, int, int]] = []
    trees: dict[tuple[int, int, int], tuple[Tree, np.ndarray]] = {}

    def tree(tile: int, width: int, fold: int) -> tuple[Tree, np.ndarray] | None:
        """The tree of a tile's signatures of one width, folded to ``fold`` bytes."""
        if (tile, width, fold) not in trees:
            own = np.flatnonzero((tiles == tile) & (widths == width))
            if not len(own):
                return None
            b = np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(len(own), -1, fold)
            trees[tile, width, fold] = (Tree(sizes[own], np.bitwise_or.reduce(b, axis=1).view(np.uint64)), own)
        return trees[tile, width, fold]

    names = sorted(set(tiles.tolist()))
    t, u = names[0], names[-1]
    every = sorted(set(widths.tolist()))
    earlier: dict[int, frozenset[int]] = {}

    def before(i: int) -> frozenset[int]:
        if i not in earlier:
            earlier[i] = frozenset(k for k in firsts[i] if k < key)
        return earlier[i]

    for w in every:
        for v in every:
            # Linked sets differ little in size, so their widths are equal or neighbours.
            if v not in (w // 2, w, w * 2) or (t == u and v > w):
                continue
            x, y = tree(t, w, min(w, v)), tree(u, v, min(w, v))
            if x is None or y is None:
                continue
            a, b = walk(x[0], y[0], percent, t == u and v == w)
            close = _closeness(x[0], y[0], a, b)
            a, b = x[1][x[0].order[a]], y[1][y[0].order[b]]
            apart = labels[a] != labels[b]
            out += [(c, i, j) for c, i, j in zip(close[apart].tolist(), a[apart].tolist(), b[apart].tolist()) if before(i).isdisjoint(before(j))]
    if forest:
        out = _forest(out, labels)
    return [(min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))) for _, i, j in out]


def _closeness(x: Tree, y: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bits that pairs of classes have in common."""
    out = np.empty(len(a))
    for k in range(0, len(a), 4096):
        p, q = x.levels[0][2][a[k : k + 4096]], y.levels[0][2][b[k : k + 4096]]
        out[k : k + 4096] = np.bitwise_count(p & q).sum(1) / np.maximum(1, np.bitwise_count(p | q).sum(1))
    return out


def _forest(pairs: list[tuple[float, int, int]], labels: np.ndarray) -> list[tuple[float, int, int]]:
    """Pairs that join what is still apart, the closest first; classes of one label are together from the start."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out = []
    for pair in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        a, b = find(int(labels[pair[1]])), find(int(labels[pair[2]]))
        if a != b:
            root[a] = b
            out.append(pair)
    return out


def _bucket(percent: int, forest: bool):
    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        bits, firsts = table.column("bits").to_pylist(), table.column("firsts").to_pylist()
        found = bucket_pairs(int(get("key")[0]), get("node"), get("n").astype(np.int64), get("label"), get("tile"), bits, firsts, percent, forest)
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return run


def _possible_links(buckets: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Stored pairs of classes of different labels that may link. ``labels`` (node, label); a class without one is its own."""
    if labels is None:
        labelled = buckets.withColumn("label", F.col("node"))
    else:
        labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Of buckets with the same classes one is enough.
    members = labelled.groupBy("key").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_rows"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")
    )
    open_keys = members.where(F.col("_lo") != F.col("_hi")).groupBy("_rows", "_x", "_y").agg(F.min("key").alias("key"))
    left = written(labelled.join(open_keys.select("key", "_rows"), "key").select("key", "node", "n", "label", "_rows"), "join-open")
    smallest = left.withColumn("_k", F.row_number().over(W.partitionBy("node").orderBy("key"))).where(F.col("_k") <= FIRSTS)
    firsts = smallest.groupBy("node").agg(F.collect_list("key").alias("firsts"))
    tiled = _in_tiles(left).join(sets.select("node", "bits").join(firsts, "node"), "node")
    return written(tiled.groupBy("key", "t", "u").applyInArrow(_bucket(percent, forest), "a long, b long").distinct(), "join-pairs")


def _in_tiles(rows: DataFrame) -> DataFrame:
    """Rows (with ``_rows`` of their bucket) of large buckets once for each pair of tiles that their own tile is in; groups hold two tiles at most."""
    cut = rows.withColumn("_tiles", F.ceil(F.col("_rows") / TILE).cast("int"))
    own = cut.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    pairs = own.select("*", other.alias("_other"))
    return pairs.select("key", "node", "n", "label", "tile", F.least("tile", "_other").alias("t"), F.greatest("tile", "_other").alias("u"))


def similar_groups(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("n_shingles", "component_id")
) -> DataFrame:
    """One row per row of ``docs``: (id, ``n_shingles``, ``component_id``): the smallest id reachable by links, itself included.

    Two texts link when the Jaccard similarity of their k-word shingle sets is at least ``percent`` / 100. A null, empty or
    blank text has no shingles and is alone; a text of fewer than k words has one. Rows with a null id take part in
    links as any other; a component without any id has a null one. Rows that repeat an id each give a row, with
    their text's component. An empty table gives no rows; other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    spark = docs.sparkSession
    ship_package(spark)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    all_rows = written(read.mapInArrow(_classes(k), "id long, hash long, node long, n long, frequent binary"), "join-classes")
    texts = all_rows.where(F.col("frequent").isNull()).select("id", "hash", "node", "n")

    # Any order of shingles gives the right links; this bounded list only keeps common shingles out of the buckets.
    common = all_rows.where(F.col("frequent").isNotNull()).select("frequent").mapInArrow(_unpack_frequent, "h long, c long")
    common = common.groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).toPandas()
    h = common["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], np.arange(len(h), 0, -1)[order]))

    rows = read.select("text").mapInArrow(_prefix_rows(k, percent, shared), "key long, node long, n int")
    near = W.partitionBy("key").orderBy("n", "node")
    before, after = F.lag(F.struct("n", "node")).over(near), F.lead(F.struct("n", "node")).over(near)
    met = rows.withColumn("_p", before).withColumn("_q", after)
    # A class needs another one of fitting size beside it; equal classes of several tasks stand side by side and fall together.
    met = met.where(
        ((F.col("_p.node") != F.col("node")) & (100 * F.col("_p.n") >= percent * F.col("n")))
        | ((F.col("_q.node") != F.col("node")) & (100 * F.col("n") >= percent * F.col("_q.n")))
    )
    met = written(met.select("key", "node", "n").distinct(), "join-buckets")
    # A partner of a set of n shingles has at least needed(n) of them.
    partner = F.floor((percent * F.col("n") + 99) / 100)
    counts = met.groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_keys"))
    strong = written(counts.where(F.col("_keys") >= 1 + F.floor(EXTRA * partner / 100)).select("node"), "join-strong")
    buckets = met.join(broadcast_if_small(strong), "node", "left_semi")

    # Sets of classes that share a bucket, from one text of each.
    one = F.min(F.struct(F.coalesce("id", F.lit((1 << 63) - 1)), "id", "hash"))
    classes = texts.where(F.col("node").isNotNull()).groupBy("node").agg(one.alias("_one")).select("node", "_one.id", "_one.hash")
    wanted = classes.join(strong, "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("hash").alias("_hash"))
    wanted = broadcast_if_small(written(wanted, "join-wanted"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash"))
    found = read.join(wanted, same).select("node", "text")
    sets = written(found.mapInArrow(_set_rows(k), "node long, hashes binary, bits binary"), "join-sets")

    first = written(_verified(_possible_links(buckets, None, sets, percent, True), sets, percent), "join-links")
    labels = written(components(first).select(F.col("id").alias("node"), F.col("component").alias("label")), "join-labels")
    more = _verified(_possible_links(buckets, labels, sets, percent, False), sets, percent)
    return _labelled(texts, classes, labels, more, id_col, names)


def _labelled(texts: DataFrame, classes: DataFrame, labels: DataFrame, more: DataFrame, id_col: str, names: tuple[str, str]) -> DataFrame:
    """Smallest ids of components back at the texts; ``more`` are links between the components that ``labels`` name."""
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    across = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = components(across).select(F.col("id").alias("_label"), F.col("component").alias("_root"))
    own = classes.join(labels, "node", "left").withColumn("_label", F.coalesce("label", "node"))
    rooted = own.join(merged, "_label", "left").select("node", "id", F.coalesce("_root", "_label").alias("_root"))
    smallest = rooted.groupBy("_root").agg(F.min("id").alias("_least"))
    out = texts.join(rooted.join(smallest, "_root").select("node", "_least"), "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("_least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias(names[0]), own.alias(names[1]))
