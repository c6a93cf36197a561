"""Many boosted-tree models over the same rows, grown side by side: one pass over the rows a level of a tree, whatever the number of models.

The trees are those of ``pyspark.ml``'s boosting (``TREE``): the first is fitted to the target, each later one to the negative
gradient of the loss; a split has the largest gain of weighted variance over at most ``maxBins`` bins a column; a leaf is the weighted
mean. Bins are cut at quantiles of all rows instead of a sample. Rows are binned and stored once, a byte a column. Tasks sum residuals and weights a
bin; these sums, of fixed size a model, are added up in a shuffle, and the driver sees their total alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from panelforge.session import stored

# The helpers travel inside the tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTINEL = -999.0
TREE = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.2, "seed": 42, "maxBins": 32}
DEPTH, BINS, STEP = TREE["maxDepth"], TREE["maxBins"], TREE["stepSize"]
#: Bin that no value exceeds: a node without a split sends all rows left.
NO_SPLIT = BINS
#: Bytes between Spark and Python at a time, and of a stored row group.
BATCH_BYTES = GROUP_BYTES = 4 << 20
#: Stored columns that are no doubles.
KINDS = {"id": np.dtype(np.int64), "is_test": np.dtype(np.int32), "fold": np.dtype(np.int32)}


@dataclass(frozen=True)
class Spec:
    """One model: its columns, and which of the stored targets and weights it uses. Rows of weight 0, or of the fold held out, take no part."""

    cols: tuple[str, ...]
    target: str
    weight: str | None = None
    loss: str = "absolute"  # or "squared", or "logistic" for targets 0 and 1
    held: int | None = None  # a value of the stored column ``fold``


@dataclass
class Tree:
    """A complete tree: split column and last bin on the left of node i of a level at 2^level - 1 + i, and the leaves from left to right."""

    col: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    leaf: np.ndarray | None = None


@dataclass
class Boosted:
    cols: tuple[str, ...]
    loss: str
    trees: list[Tree]
    edges: dict[str, np.ndarray]

    def importances(self) -> dict[str, float]:
        """Shares of the summed gains."""
        total = dict.fromkeys(self.cols, 0.0)
        for t in self.trees:
            for c, cut, gain in zip(t.col, t.cut, t.gain):
                if cut != NO_SPLIT:
                    total[self.cols[c]] += gain
        whole = sum(total.values()) or 1.0
        return {c: v / whole for c, v in total.items()}

    def margin(self) -> Column:
        """The sum of the trees as an expression of the columns."""

        def node(t: Tree, at: int) -> str:
            if at >= len(t.col):
                return f"{float(t.leaf[at - len(t.col)])!r}D"
            if t.cut[at] == NO_SPLIT:
                return node(t, 2 * at + 1)
            c = self.cols[t.col[at]]
            return f"CASE WHEN coalesce(`{c}`, {SENTINEL!r}D) <= {float(self.edges[c][t.cut[at]])!r}D THEN {node(t, 2 * at + 1)} ELSE {node(t, 2 * at + 2)} END"

        return F.expr(" + ".join(f"{STEP if i else 1.0!r}D * {node(t, 0)}" for i, t in enumerate(self.trees)))

    def value(self, log: bool = True) -> Column:
        """The prediction, or the probability of target 1; ``log`` undoes a target of log(1 + y)."""
        m = self.margin()
        return 1.0 / (1.0 + F.exp(-2.0 * m)) if self.loss == "logistic" else F.expm1(m) if log else m


    def record(self) -> dict:
        trees = [{"col": t.col, "cut": t.cut, "gain": t.gain, "leaf": t.leaf.tolist()} for t in self.trees]
        return {"cols": list(self.cols), "loss": self.loss, "trees": trees, "edges": {c: e.tolist() for c, e in self.edges.items()}}

    @staticmethod
    def of_record(r: dict) -> Boosted:
        trees = [Tree(t["col"], t["cut"], t["gain"], np.array(t["leaf"])) for t in r["trees"]]
        return Boosted(tuple(r["cols"]), r["loss"], trees, {c: np.array(e) for c, e in r["edges"].items()})


def bin_edges(rows: DataFrame, cols: Sequence[str]) -> dict[str, np.ndarray]:
    """Upper ends of all bins but the last: every value of a column with at most ``BINS`` values, else quantiles of all rows."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in cols}
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[a for c in cols for a in (F.percentile_approx(x[c], steps, 10_000).alias(f"q_{c}"), F.approx_count_distinct(x[c]).alias(f"n_{c}"))]).first()
    few = [c for c in cols if found[f"n_{c}"] <= 2 * BINS]
    sets = rows.agg(*[F.collect_set(x[c]).alias(c) for c in few]).first() if few else {}
    out = {}
    for c in cols:
        values = np.unique(sets[c])[:-1] if c in few and len(sets[c]) <= BINS else np.unique(found[f"q_{c}"] or [])
        out[c] = values[np.isfinite(values)]
    return out


def coded(rows: DataFrame, edges: Mapping[str, np.ndarray], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., _bins): the bin of every column of ``edges`` as a byte, in their order."""
    keep, cuts = list(keep), list(edges.values())
    plain = rows.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)).alias(f"_x{i}") for i, c in enumerate(edges)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.empty((b.num_rows, len(cuts)), np.int8)
            for i, cut in enumerate(cuts):
                bins[:, i] = np.searchsorted(cut, b.column(len(keep) + i).to_numpy(zero_copy_only=False))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(cuts)
            code = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], code], names=[*keep, "_bins"])

    return plain.mapInArrow(place, StructType([*rows.select(*keep).schema.fields, StructField("_bins", BinaryType())]))


def in_blocks(rows: DataFrame, columns: int) -> DataFrame:
    """Coded rows, stored with some ten thousand rows as one: every column the bytes of its values, the bins column by column.

    Passes over the rows cost what their arithmetic costs; a row of its own costs the way from Parquet to Python besides.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    keep = [c for c in rows.columns if c != "_bins"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(len(keep))
            ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + b.num_rows + 1]
            bins = np.frombuffer(code.buffers()[2] or b"", np.int8)[ends[0] : ends[-1]].reshape(b.num_rows, columns).T
            parts = [b.column(i).to_numpy(zero_copy_only=False).tobytes() for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*parts, bins.tobytes())], names=[*keep, "_bins"])

    # Small row groups, as a block is one large row.
    small = {"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return stored(rows.select(*keep, "_bins").mapInArrow(pack, ", ".join(f"{c} binary" for c in (*keep, "_bins"))), **small)


def blocks_of(b: pa.RecordBatch, kinds: Sequence[np.dtype], columns: int) -> Iterator[list[np.ndarray]]:
    """Per block its columns, the bins first, one row of them a column."""
    for i in range(b.num_rows):
        code, *rest = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in enumerate((np.int8, *kinds)))
        yield [code.reshape(columns, -1), *rest]


def binned(rows: DataFrame, edges: Mapping[str, np.ndarray], kept: Mapping[str, Column]) -> DataFrame:
    """Blocks of the bins of all columns and the targets and weights as they are."""
    plain = rows.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(edges)], *[v.cast("double").alias(k) for k, v in kept.items()])
    # Coalesced shuffles leave few files; every pass over the rows needs a share for each core.
    plain = plain.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)
    return in_blocks(coded(plain, {f"_x{i}": cut for i, cut in enumerate(edges.values())}, list(kept)), len(edges))


def walk(x: Sequence[np.ndarray], col: Sequence[int], cut: Sequence[int], levels: int, n: int) -> np.ndarray:
    """The place of every row among the nodes of a level: one comparison a node, then a choice among its children by bits."""
    over = [(x[c] > np.int8(b)).view(np.uint8) for c, b in zip(col[: 2**levels - 1], cut)]
    node, taken = np.zeros(n, np.uint8), []
    for level in range(levels):
        bits = over[2**level - 1 : 2 ** (level + 1) - 1]
        for t in reversed(taken):
            bits = [((bits[i] ^ bits[i + 1]) & t) ^ bits[i] for i in range(0, len(bits), 2)] if len(bits) > 1 else bits
        taken.append(bits[0])
        node = node + node + bits[0]
    return node


def scores(x: Sequence[np.ndarray], trees: Sequence[Tree], n: int) -> np.ndarray:
    """The sum of the trees for every row; two trees are looked up together."""
    total, leaves = np.zeros(n), [(STEP if i else 1.0) * t.leaf for i, t in enumerate(trees)]
    for i in range(0, len(trees) - 1, 2):
        both = (walk(x, trees[i].col, trees[i].cut, DEPTH, n) << DEPTH) | walk(x, trees[i + 1].col, trees[i + 1].cut, DEPTH, n)
        total += np.add.outer(leaves[i], leaves[i + 1]).ravel().take(both)
    if len(trees) % 2:
        total += leaves[-1].take(walk(x, trees[-1].col, trees[-1].cut, DEPTH, n))
    return total


def residual(loss: str, y: np.ndarray, trees: Sequence[Tree], x: Sequence[np.ndarray]) -> np.ndarray:
    """What the next tree is fitted to."""
    if loss == "logistic":
        y = 2.0 * y - 1.0
    if not trees:
        return y
    score = scores(x, trees, len(y))
    if loss == "logistic":
        return 4.0 * y / (1.0 + np.exp(2.0 * y * score))
    return np.where(y >= score, 1.0, -1.0) if loss == "absolute" else 2.0 * (y - score)


def level_sums(table: DataFrame, places: Mapping[str, int], specs: Sequence[Spec], grown: Sequence[Sequence[Tree]], level: int) -> list[np.ndarray]:
    """Per model an array (weights or weighted residuals, column, node, bin) over all rows; the last tree of each model is the growing one."""
    kept = sorted({n for s in specs for n in (s.target, s.weight, "fold" if s.held is not None else None) if n})
    kinds = [KINDS.get(n, np.dtype(float)) for n in kept]
    own = [[places[c] for c in s.cols] for s in specs]
    shapes = [(2, len(s.cols), 2**level * BINS) for s in specs]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in shapes]
        for bins, *rest in (block for b in batches for block in blocks_of(b, kinds, len(places))):
            at = dict(zip(kept, rest))
            for k, spec in enumerate(specs):
                x, y, w = [bins[i] for i in own[k]], at[spec.target], at[spec.weight] if spec.weight else None
                if spec.held is not None:
                    take = np.flatnonzero(at["fold"] != spec.held)
                    x, y, w = [v[take] for v in x], y[take], w if w is None else w[take]
                if w is not None and not w.all():
                    take = np.flatnonzero(w)
                    x, y, w = [v[take] for v in x], y[take], w[take]
                r = residual(spec.loss, y, grown[k][:-1], x)
                base = walk(x, grown[k][-1].col, grown[k][-1].cut, level, len(y)).astype(np.int64) * BINS
                size = shapes[k][2]
                if spec.loss == "absolute" and len(grown[k]) > 1:  # residuals are 1 and -1: one count for each
                    base += (r > 0) * size
                    for j, v in enumerate(x):
                        down, up = np.bincount(base + v, w, 2 * size).reshape(2, size)
                        total[k][0, j] += up + down
                        total[k][1, j] += up - down
                    continue
                r = r if w is None else r * w
                for j, v in enumerate(x):
                    cell = base + v
                    total[k][0, j] += np.bincount(cell, w, size)
                    total[k][1, j] += np.bincount(cell, r, size)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(specs)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["model", "sums"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(len(parts["sums"].iloc[0]) // 8)
        for p in parts["sums"]:
            whole += np.frombuffer(p)
        return pd.DataFrame({"model": parts["model"].iloc[:1], "sums": [whole.tobytes()]})

    schema = "model int, sums binary"
    found = {r.model: r.sums for r in table.select("_bins", *kept).mapInArrow(sums, schema).groupBy("model").applyInPandas(add, schema).collect()}
    return [np.frombuffer(found[k]).reshape(2, len(s.cols), 2**level, BINS) for k, s in enumerate(specs)]


def split_level(tree: Tree, sums: np.ndarray) -> np.ndarray:
    """Append the best split of each node of a level; returns the means of the nodes below."""
    w, s = sums
    whole_w, whole_s = w[0].sum(axis=1), s[0].sum(axis=1)
    left_w, left_s = w.cumsum(axis=2)[:, :, :-1], s.cumsum(axis=2)[:, :, :-1]
    right_w, right_s = whole_w[None, :, None] - left_w, whole_s[None, :, None] - left_s
    least = 1e-9 * np.maximum(whole_w, 1e-300)[None, :, None]  # what rounding leaves of an empty side
    with np.errstate(divide="ignore", invalid="ignore"):
        before = np.where(whole_w > 0, whole_s**2 / whole_w, 0.0)
        gain = np.where((left_w > least) & (right_w > least), left_s**2 / left_w + right_s**2 / right_w - before[None, :, None], 0.0)
    means = []
    for i in range(w.shape[1]):
        j, b = np.unravel_index(np.argmax(gain[:, i]), gain[:, i].shape)
        best = float(gain[j, i, b])
        mean = float(whole_s[i] / whole_w[i]) if whole_w[i] > 0 else 0.0
        if best > 1e-12 * max(whole_w[i], abs(before[i])):
            tree.col.append(int(j)), tree.cut.append(int(b)), tree.gain.append(best)
            means += [float(left_s[j, i, b] / left_w[j, i, b]), float(right_s[j, i, b] / right_w[j, i, b])]
        else:
            tree.col.append(0), tree.cut.append(NO_SPLIT), tree.gain.append(0.0)
            means += [mean, mean]
    return np.array(means)


def grow(table: DataFrame, edges: Mapping[str, np.ndarray], specs: Sequence[Spec], trees: int = TREE["maxIter"]) -> list[Boosted]:
    """The models of all specs over rows that are binned by ``edges`` already."""
    places = {c: i for i, c in enumerate(edges)}
    grown: list[list[Tree]] = [[] for _ in specs]
    for _ in range(trees):
        for own in grown:
            own.append(Tree())
        for level in range(DEPTH):
            for own, sums in zip(grown, level_sums(table, places, specs, grown, level)):
                own[-1].leaf = split_level(own[-1], sums)
    return [Boosted(s.cols, s.loss, own, {c: edges[c] for c in s.cols}) for s, own in zip(specs, grown)]


def fit_all(rows: DataFrame, specs: Sequence[Spec], kept: Mapping[str, Column], trees: int = TREE["maxIter"]) -> list[Boosted]:
    """The models of all specs; ``kept`` names the targets and weights they use. A model without rows predicts 0."""
    edges = bin_edges(rows, list(dict.fromkeys(c for s in specs for c in s.cols)))
    return grow(binned(rows, edges, kept), edges, specs, trees)


def chances_by_fold(table: DataFrame, edges: Mapping[str, np.ndarray], models: Sequence[Boosted]) -> DataFrame:
    """(id, is_test, fold, p) of binned rows: the probability that the model of their own fold gives them."""
    places, kinds = {c: i for i, c in enumerate(edges)}, list(KINDS.values())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, *rest in (block for b in batches for block in blocks_of(b, kinds, len(places))):
            total = np.zeros(len(rest[0]))
            for f, m in enumerate(models):
                own = np.flatnonzero(rest[-1] == f)
                total[own] = scores([bins[places[c]][own] for c in m.cols], m.trees, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rest, 1.0 / (1.0 + np.exp(-2.0 * total)))], names=[*KINDS, "p"])

    return table.select("_bins", *KINDS).mapInArrow(score, "id bigint, is_test int, fold int, p double")


def with_values(df: DataFrame, models: Mapping[str, Boosted]) -> DataFrame:
    """``df`` with the value of each model under its name, as ``value`` gives it; many trees are too long for one expression."""
    cols, after, names = list(dict.fromkeys(c for m in models.values() for c in m.cols)), len(df.columns), [*df.columns, *models]
    plain = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)).alias(f"_x{i}") for i, c in enumerate(cols)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, out = {c: b.column(after + i).to_numpy(zero_copy_only=False) for i, c in enumerate(cols)}, []
            for m in models.values():
                total = scores([np.searchsorted(m.edges[c], x[c]).astype(np.int8) for c in m.cols], m.trees, b.num_rows)
                out.append(pa.array(1.0 / (1.0 + np.exp(-2.0 * total)) if m.loss == "logistic" else np.expm1(total), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:after], *out], names=names)

    return plain.mapInArrow(score, StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in models]]))


def values_of_all(rows: DataFrame, models: Sequence[Boosted], kept: Mapping[str, Column], log: bool = True) -> DataFrame:
    """The kept values of every row, with the value of model i as ``p<i>``; for models of one ``fit_all``, which share their bins."""
    edges = {c: e for m in models for c, e in m.edges.items()}
    table, places = binned(rows, edges, kept), {c: i for i, c in enumerate(edges)}
    names, kinds = [*kept, *[f"p{i}" for i in range(len(models))]], [np.dtype(float)] * len(kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, *out in (block for b in batches for block in blocks_of(b, kinds, len(places))):
            for m in models:
                total = scores([bins[places[c]] for c in m.cols], m.trees, bins.shape[1])
                out.append(1.0 / (1.0 + np.exp(-2.0 * total)) if m.loss == "logistic" else np.expm1(total) if log else total)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in out], names=names)

    return table.select("_bins", *kept).mapInArrow(score, ", ".join(f"{n} double" for n in names))
