"""A Merkle manifest of a dataset: one tree per group, one tree over the groups' roots, and proofs by octopus multiproofs.

Nodes are SHA-256 digests (lower-case hex) of what stands below them, two nodes at a time; the last run of a level may be one node.
A tree is cut into blocks of BLOCK leaves. A block gives its top node; the tops of BLOCK blocks give theirs, and so on, so no task ever
holds more than BLOCK nodes of a tree. To prove its leaves, a block finds the least set of node coordinates that its leaves cannot
give (an octopus multiproof), fetches these nodes once, derives the nodes that its proofs share, and spells each leaf's proof.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import BROADCAST_ROWS, broadcast_if_small, ship_package, written

BLOCK_BITS = 10
#: Levels of the tree over the groups count from here, above those of any group's own tree.
UPPER = 64


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level of a tree with ``n`` leaves, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def missing_nodes(known: Sequence[int], n: int) -> list[tuple[int, int]]:
    """The fewest (level, index) with which the leaves at the sorted places ``known`` of ``n`` give the root.

    Level by level, a node's sibling is missing if it exists and is not known; parents of known nodes are known.
    """
    out, here = [], list(known)
    for level, size in enumerate(level_sizes(n)[:-1]):
        there = set(here)
        out += [(level, i ^ 1) for i in here if i ^ 1 < size and i ^ 1 not in there]
        here = sorted({i >> 1 for i in here})
    return out


def derived_nodes(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> dict[tuple[int, int], str]:
    """All nodes on the ways of ``leaves`` to the root and beside them, from the leaves and their missing nodes."""
    sizes = level_sizes(n)
    nodes = fetched | {(0, i): h for i, h in leaves.items()}
    here = sorted(leaves)
    for level, size in enumerate(sizes[:-1]):
        here = sorted({i >> 1 for i in here})
        for i in here:
            pair = (nodes[level, 2 * i], nodes[level, 2 * i + 1]) if 2 * i + 1 < size else (nodes[level, 2 * i],)
            nodes[level + 1, i] = digest(*pair)
    return nodes


def proof_of(nodes: dict[tuple[int, int], str], i: int, n: int) -> list[tuple[int, str]]:
    """(side, sibling) level by level for the leaf at place ``i``: 0 left, 1 right, or (2, "") where the run is one node."""
    out = []
    for level, size in enumerate(level_sizes(n)[:-1]):
        at = i >> level
        out.append((1 - (at & 1), nodes[level, at ^ 1]) if at ^ 1 < size else (2, ""))
    return out


def folded(leaf: str, proof: Sequence[tuple[int, str]]) -> str:
    """The root that ``leaf`` and its proof give."""
    for side, sibling in proof:
        leaf = digest(sibling, leaf) if side == 0 else digest(leaf, sibling)
    return leaf


def placed(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The stored ``df`` with ``pos``, a row's place from 0 in its group by ``order``, and ``n``, the group's rows.

    Rows are dealt by ranges of (group, order, row), so a large group spans many ranges; a row's place is its place in its range
    plus the rows of its group in earlier ranges. There is one count for each group of each range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_row"]
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("_row").withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)), "merkle-ranges")
    spans = dealt.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n")), "merkle-spans")
    joined = dealt.join(broadcast_if_small(spans), [group, "_range"])
    return joined.withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")


_NODE = "tree long, level int, idx long, hash string, n long"


def _fold_block(round_: int):
    bits, base = BLOCK_BITS, BLOCK_BITS * round_

    def run(table: pa.Table) -> pa.Table:
        """A block's top node and, from the second round on, the nodes between."""
        nodes = sorted(zip(table["idx"].to_pylist(), table["hash"].to_pylist()))
        tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
        height, out = len(level_sizes(n)) - 1, []
        for level in range(base + 1, min(base + bits, height) + 1):
            nodes = [(nodes[k][0] >> 1, digest(*[h for _, h in nodes[k : k + 2]])) for k in range(0, len(nodes), 2)]
            if round_ or level == min(base + bits, height):
                out += [(level, i, h) for i, h in nodes]
        if not height:
            out = [(0, *nodes[0])]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        columns = [[tree] * len(out), [o[0] for o in out], [o[1] for o in out], [o[2] for o in out], [n] * len(out)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _NODE.split(", ")])

    return run


def build_trees(leaves: DataFrame) -> DataFrame:
    """The stored nodes (tree, level, idx, hash, n) from the blocks' tops up to the roots of ``leaves`` (tree, idx, hash, n)."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    height, parts, here = len(level_sizes(most)) - 1, [], leaves
    for round_ in range(max(1, -(-height // BLOCK_BITS))):
        blocks = here.groupBy("tree", F.shiftright("idx", BLOCK_BITS).alias("_block"))
        parts.append(written(blocks.applyInArrow(_fold_block(round_), _NODE), "merkle-nodes"))
        top = BLOCK_BITS * (round_ + 1)
        # A tree goes on if its level at the top has more than one node.
        here = parts[-1].where((F.col("level") == top) & (F.col("n") > F.lit(1 << top)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roots(nodes: DataFrame) -> DataFrame:
    """(tree, n, root) of each tree: the one node on the level that its number of leaves gives."""
    last = nodes.groupBy("tree", "n").agg(F.max_by("hash", "level").alias("root"))
    return last.select("tree", "n", "root")


def _coordinates(bits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block (tree, block, n, trees), the nodes that its leaves cannot give: (tree, block, of, level, idx)."""
        for batch in it:
            out = []
            for r in batch.to_pylist():
                first = r["block"] << bits
                own = range(first, min(first + (1 << bits), r["n"]))
                out += [(r["tree"], r["block"], r["tree"], level, i) for level, i in missing_nodes(own, r["n"])]
                out += [(r["tree"], r["block"], -1, UPPER + level, i) for level, i in missing_nodes([r["tree"]], r["trees"])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], names=["tree", "block", "of", "level", "idx"])

    return run


def fetch(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, block, level, idx, hash): the missing nodes of every block of ``blocks`` (tree, block, n, trees).

    Nodes from some level on, BROADCAST_ROWS at most, are broadcast; many blocks ask for these. Nodes below that level are
    joined by a shuffle; only the blocks below a node's sibling ask for it.
    """
    wanted = blocks.mapInArrow(_coordinates(BLOCK_BITS), "tree long, block long, of long, level int, idx long")
    nodes = nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    held, cut = 0, None
    for level, n in sorted(map(tuple, nodes.groupBy("level").count().collect()), reverse=True):  # levels are few
        held += n
        if held > BROADCAST_ROWS:
            cut = level + 1
            break
    keys = ["of", "level", "idx"]
    if cut is None:
        found = wanted.join(F.broadcast(nodes), keys)
    else:
        upper = wanted.where(F.col("level") >= cut).join(F.broadcast(nodes.where(F.col("level") >= cut)), keys)
        found = upper.unionByName(wanted.where(F.col("level") < cut).join(nodes.where(F.col("level") < cut), keys))
    return found.select("tree", "block", "level", "idx", "hash")


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _prove(root: str):
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        """All proofs of one block."""
        rows = leaves.to_pylist()
        out = []
        if rows:
            tree, n, trees, subroot = rows[0]["tree"], rows[0]["n"], rows[0]["trees"], rows[0]["subroot"]
            given = {(r["level"], r["idx"]): r["hash"] for r in fetched.to_pylist()}
            own = derived_nodes({r["pos"]: r["leaf"] for r in rows}, {k: h for k, h in given.items() if k[0] < UPPER}, n)
            upper = proof_of({(k - UPPER, i): h for (k, i), h in given.items() if k >= UPPER}, tree, trees)
            for r in rows:
                proof = proof_of(own, r["pos"], n) + upper
                out.append((r["doc_id"], r["leaf"], subroot, root, digest(*[h for _, h in proof]), folded(r["claimed"], proof)))
        names = [f.split()[0] for f in _PROOF.split(", ")]
        return pa.table([pa.array([o[c] for o in out], pa.int64() if not c else pa.string()) for c in range(len(names))], names=names)

    return run


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and itself; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def manifest(docs: DataFrame, columns: Sequence[str], claimed: dict[str, Column], group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    A leaf covers ``columns`` in order. Leaves of a group stand in ascending id (null ids first, equal ids by leaf, equal rows in any order, which
    changes nothing); groups in bytewise order, null first. ``claimed`` replaces columns by what a holder claims
    them to be: ``folded_root`` is what the claimed leaf and the true proof give, and ``verified`` says whether that is the
    root. Repeated rows are leaves of their own. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    true = leaf_of([F.col(f"`{c}`") for c in columns])
    changed = [claimed.get(c, F.col(f"`{c}`")) for c in columns]
    same = F.lit(True)
    for c in claimed:
        same = same & claimed[c].eqNullSafe(F.col(f"`{c}`"))
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    read = docs.select(key.alias("group"), F.col(id_col).cast("long").alias("doc_id"), true.alias("leaf"), F.when(~same, leaf_of(changed)).alias("other"))
    leaves = placed(written(read, "merkle-leaves"), "group", ["doc_id", "leaf"])
    groups = written(leaves.groupBy("group").agg(F.first("n").alias("leaves")), "merkle-groups")
    trees = written(placed(groups.withColumn("all", F.lit(0)), "all", ["group"]).select("group", F.col("pos").alias("tree"), F.col("n").alias("trees")), "merkle-trees")
    leaves = written(leaves.join(broadcast_if_small(trees), "group").drop("group"), "merkle-leaves")
    nodes = build_trees(leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "n"))
    subroots = written(roots(nodes), "merkle-roots")
    tops = trees.select("tree", "trees").join(subroots, "tree")
    above = _upper_tree(tops)
    top = roots(above).first()
    if top is None:
        return spark.createDataFrame([], f"{_PROOF}, verified boolean")
    blocks = leaves.select("tree", F.shiftright("pos", BLOCK_BITS).alias("block"), "n", "trees").distinct()
    lowered = above.select(F.lit(-1).cast("long").alias("tree"), (F.col("level") + UPPER).alias("level"), "idx", "hash", "n")
    found = fetch(blocks, nodes.unionByName(lowered))
    rows = leaves.join(broadcast_if_small(subroots.select("tree", F.col("root").alias("subroot"))), "tree")
    rows = rows.select("tree", "doc_id", "pos", "n", "trees", "leaf", F.coalesce("other", "leaf").alias("claimed"), "subroot")
    by_block = rows.groupBy("tree", F.shiftright("pos", BLOCK_BITS).alias("block"))
    proofs = by_block.cogroup(found.groupBy("tree", "block")).applyInArrow(_prove(top["root"]), _PROOF)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def _upper_tree(tops: DataFrame) -> DataFrame:
    """All nodes of the tree over the groups' roots, its leaves included."""
    leaves = written(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("root").alias("hash"), F.col("trees").alias("n")), "merkle-upper")
    base = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", "n")
    parts, here, level = [base], leaves, 0
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        # Two nodes at a time: the groups are few, and proofs over them need every level.
        level, most = level + 1, (most + 1) // 2
        pairs = here.groupBy("tree", F.shiftright("idx", 1).alias("idx"), "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]), "").alias("_both"))
        here = written(pairs.select("tree", "idx", F.sha2("_both", 256).alias("hash"), "n"), "merkle-upper")
        parts.append(here.select("tree", F.lit(level).alias("level"), "idx", "hash", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
