"""Boosted-tree models on ``pyspark.ml``: two-stage tail model, adversarial checks, importance and pruning loops.

Every loop is over folds, settings or columns.  A frame that several fits read is stored once, never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions import exprs as X
from panelforge.operators import boosting as B, drift, policies as PO, ranks, splits
from panelforge.operators.boosting import SENTINEL, TREE
from panelforge.operators.sets import labelled_union
from panelforge.operators.prefix import row_positions
from panelforge.operators.quantiles import fit_quantiles
from panelforge.session import cut_lineage, stored


def assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def with_sentinel(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(SENTINEL, subset=list(cols))


def fit_regressor(df: DataFrame, cols: Sequence[str], y: str = "y", log: bool = True, weight: str | None = None, loss: str = "absolute", **tree) -> PipelineModel:
    """Boosted regressor of y, or of log(1 + y); the transform of the target is undone by ``predict``."""
    target = F.log1p(y) if log else F.col(y).cast("double")
    gbt = GBTRegressor(labelCol="_y", lossType=loss, weightCol=weight, **{**TREE, **tree}) if weight else GBTRegressor(labelCol="_y", lossType=loss, **{**TREE, **tree})
    return Pipeline(stages=[assembler(cols), gbt]).fit(with_sentinel(df, cols).withColumn("_y", target))


def predict(model: PipelineModel, df: DataFrame, cols: Sequence[str], name: str, log: bool = True) -> DataFrame:
    out = model.transform(with_sentinel(df, cols))
    value = F.expm1("prediction") if log else F.col("prediction")
    return out.withColumn(name, value).drop("features", "prediction")


def fit_classifier(df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None, **tree) -> PipelineModel:
    args = {**TREE, **tree}
    gbt = GBTClassifier(labelCol="_l", weightCol=weight, **args) if weight else GBTClassifier(labelCol="_l", **args)
    return Pipeline(stages=[assembler(cols), gbt]).fit(with_sentinel(df, cols).withColumn("_l", F.col(label).cast("double")))


def probability(model: PipelineModel, df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    out = model.transform(with_sentinel(df, cols))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, cols: Sequence[str]) -> dict[str, float]:
    return dict(zip(cols, (float(v) for v in model.stages[-1].featureImportances.toArray())))


def mae(df: DataFrame, y: str, pred: str) -> float:
    return df.where(F.col(pred).isNotNull()).agg(F.avg(F.abs(F.col(y) - F.col(pred)))).first()[0]


# --- two-stage model ----------------------------------------------------------------------------------------


@dataclass
class TwoStage:
    """Tail classifier plus a regressor for either side of the training q90, and their column lists."""

    q90: float
    clf: PipelineModel
    tail: PipelineModel
    bulk: PipelineModel
    cols: list[str]
    clf_cols: list[str]
    tail_cols: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add p, t, nt and the gated, damped blend."""
        out = probability(self.clf, df, self.clf_cols, "p")
        out = predict(self.tail, out, self.tail_cols, "t")
        out = predict(self.bulk, out, self.cols, "nt")
        return PO.assemble(out)

    def save(self, path: str) -> None:
        for name in ("clf", "tail", "bulk"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")

    def restored(self, path: str) -> "TwoStage":
        loaded = {n: PipelineModel.load(f"{path}/{n}") for n in ("clf", "tail", "bulk")}
        return TwoStage(self.q90, loaded["clf"], loaded["tail"], loaded["bulk"], self.cols, self.clf_cols, self.tail_cols)


def fit_two_stage(train: DataFrame, cols: Sequence[str], y: str = "y", poison: Sequence[str] = (), destructive: Sequence[str] = (), pos_weight: float = 2.0, weight: str | None = None, **tree) -> TwoStage:
    q90 = fit_quantiles(train, {"y": (F.col(y), [0.9])})["y"][0]
    rows = train.withColumn("_tail", F.col(y) >= q90).withColumn("_w", F.when(F.col("_tail"), pos_weight).otherwise(1.0))
    clf_cols, tail_cols = [c for c in cols if c not in poison], [c for c in cols if c not in destructive]
    clf = fit_classifier(rows, clf_cols, "_tail", weight="_w", **tree)
    tail = fit_regressor(rows.where("_tail"), tail_cols, y, weight=weight, loss="squared", **tree)
    bulk = fit_regressor(rows.where("NOT _tail"), list(cols), y, weight=weight, **tree)
    return TwoStage(q90, clf, tail, bulk, list(cols), clf_cols, tail_cols)


@dataclass
class Stages:
    """The same three models, grown side by side in shared passes over rows that are binned once; kept as plain numbers."""

    q90: float
    clf: B.Boosted
    tail: B.Boosted
    bulk: B.Boosted

    @property
    def cols(self) -> list[str]:
        return list(self.bulk.cols)

    @property
    def clf_cols(self) -> list[str]:
        return list(self.clf.cols)

    @property
    def tail_cols(self) -> list[str]:
        return list(self.tail.cols)

    @staticmethod
    def fit(train: DataFrame, cols: Sequence[str], y: str = "y", poison: Sequence[str] = (), destructive: Sequence[str] = (), pos_weight: float = 2.0, weight: str | None = None, maxIter: int = TREE["maxIter"]) -> Stages:
        q90 = fit_quantiles(train, {"y": (F.col(y), [0.9])})["y"][0]
        tail, w = F.col(y) >= q90, F.col(weight) if weight else F.lit(1.0)
        kept = {"target": F.log1p(y), "tail": tail, "w_clf": F.when(tail, pos_weight).otherwise(1.0), "w_tail": F.when(tail, w).otherwise(0.0), "w_bulk": F.when(tail, 0.0).otherwise(w)}
        specs = [
            B.Spec(tuple(c for c in cols if c not in poison), "tail", "w_clf", "logistic"),
            B.Spec(tuple(c for c in cols if c not in destructive), "target", "w_tail", "squared"),
            B.Spec(tuple(cols), "target", "w_bulk"),
        ]
        return Stages(q90, *B.fit_all(train, specs, kept, maxIter))

    def score(self, df: DataFrame) -> DataFrame:
        """Add p, t, nt and the gated, damped blend."""
        return PO.assemble(B.with_values(df, {"p": self.clf, "t": self.tail, "nt": self.bulk}))

    def record(self) -> dict:
        return {"q90": self.q90} | {n: getattr(self, n).record() for n in ("clf", "tail", "bulk")}

    @staticmethod
    def of_record(r: dict) -> Stages:
        return Stages(r["q90"], *[B.Boosted.of_record(r[n]) for n in ("clf", "tail", "bulk")])


def fold_frames(rows: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one expanding-window fold of rows that carry their chunk."""
    return rows.where(F.col("chunk") <= fold + 1), rows.where(F.col("chunk") == fold + 2)


def stable_columns(train: DataFrame, other: DataFrame, cols: Sequence[str], limit: float) -> list[str]:
    """Columns whose KS between the two frames stays within the limit; all of them if fewer than two would."""
    kept = drift.ks_within(labelled_union(train.select(*cols), other.select(*cols)), list(cols), F.col("is_test") == 0, limit)
    return [c for c in cols if c in kept] if len(kept) >= 2 else list(cols)


def train_two_pass(rows: DataFrame, test: DataFrame, cols: Sequence[str], n_folds: int, ks_limit: float = 0.2, **tree):
    """Pass one picks columns per fold, pass two fits every fold on the columns all folds kept.

    Returns (common columns, models, out-of-fold rows, test rows averaged over folds).
    """
    kept = [set(stable_columns(fold_frames(rows, f)[0], test, cols, ks_limit)) for f in range(n_folds)]
    common = sorted(set.intersection(*kept))
    if not common:
        raise RuntimeError("no column is stable in every fold")
    fitted, oof, scored = [], None, None
    for f in range(n_folds):
        train, val = fold_frames(rows, f)
        m = fit_two_stage(train, common, **tree)
        fitted.append(m)
        o = m.score(val).select("id", "y", F.lit(f).alias("fold"), "p", "t", "nt", F.col("blended").alias("oof"))
        s = m.score(test).select("id", F.col("blended").alias("pred"))
        oof, scored = (o, s) if oof is None else (oof.unionByName(o), scored.unionByName(s))
    return common, fitted, oof, PO.fold_ensemble(scored, "id", "pred")


# --- adversarial validation -------------------------------------------------------------------------------------


@dataclass
class Sides:
    """All rows of both sides, binned, dealt to folds and stored once, as blocks of (id, is_test, fold, _bins)."""

    table: DataFrame
    edges: Mapping
    folds: int

    @staticmethod
    def of(a: DataFrame, b: DataFrame, cols: Sequence[str], folds: int = 3, seed: int = 42, edges: Mapping | None = None) -> Sides:
        """Rows that ``dealt`` gave a fold keep it."""
        own = ["_fold"] if "_fold" in a.columns and "_fold" in b.columns else []
        both = labelled_union(a.select("id", *own, *cols), b.select("id", *own, *cols))
        edges = edges or B.bin_edges(both, cols)
        table = B.coded(both, edges, ["id", "is_test", *own])
        table = table.withColumnRenamed("_fold", "fold") if own else splits.stratified_folds(table, "is_test", folds, "id", seed, both.select("is_test", "id"))
        return Sides(B.in_blocks(table, len(edges)), edges, folds)

    def scores(self, cols: Sequence[str], fit_on: Sides | None = None, maxIter: int = TREE["maxIter"]) -> tuple[DataFrame, dict[str, float]]:
        """Out-of-fold probability of every row, and the importances averaged over the folds' classifiers, which grow in shared passes."""
        models = B.grow((fit_on or self).table, self.edges, [B.Spec(tuple(cols), "is_test", loss="logistic", held=f) for f in range(self.folds)], maxIter)
        gains = [m.importances() for m in models]
        return B.chances_by_fold(self.table, self.edges, models), {c: sum(g[c] for g in gains) / self.folds for c in cols}

    def auc(self, cols: Sequence[str], **kw) -> tuple[float, dict[str, float]]:
        scored, total = self.scores(cols, **kw)
        per = ranks.roc_auc(scored, ["fold"], "p", F.col("is_test") == 1)
        return per.agg(F.avg("auc")).first()[0], total


def dealt(a: DataFrame, b: DataFrame, folds: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Both sides with the fold of every row, stored: fits of several column sets share it."""
    both = labelled_union(a, b)
    table = stored(splits.stratified_folds(both, "is_test", folds, "id", seed, both.select("is_test", "id")).withColumnRenamed("fold", "_fold"))
    return table.where("is_test = 0").drop("is_test"), table.where("is_test = 1").drop("is_test")


def adversarial_scores(a: DataFrame, b: DataFrame, cols: Sequence[str], folds: int = 3, fit_rows: int | None = None, seed: int = 42, **tree):
    """Out-of-fold probability that a row belongs to ``b``, for every row, and the importances averaged over folds.

    The classifier of a fold is fitted on all rows of the other folds, unless the caller bounds them to about ``fit_rows`` of each side (no registered query does).
    """
    if fit_rows is None:
        return Sides.of(a, b, cols, folds, seed).scores(cols, **tree)
    a, b = dealt(a.select("id", *cols), b.select("id", *cols), folds, seed)
    every = Sides.of(a, b, cols, folds)
    few = [cut_lineage(x.where(splits.unit_hash(F.col("id"), seed=seed + 1) < fit_rows / max(1, x.count()))) for x in (a, b)]
    return every.scores(cols, Sides.of(*few, cols, folds, edges=every.edges), **tree)


def adversarial_auc(a: DataFrame, b: DataFrame, cols: Sequence[str], folds: int = 3, seed: int = 42, **kw) -> tuple[float, dict[str, float]]:
    return Sides.of(a, b, cols, folds, seed).auc(cols, **kw)


def shift_status(auc: Column) -> Column:
    # Limits and words of the verdict.
    return F.when(auc < 0.60, "SAFE_PROXY").when(auc < 0.75, "MODERATE_SHIFT").otherwise("SEVERE_SHIFT")


def prune_collective_drift(a: DataFrame, b: DataFrame, cols: Sequence[str], target_auc: float = 0.75, step: int = 1, rounds: int | None = None, protected: Sequence[str] = (), enforce_protection: bool = False, folds: int = 3, **kw):
    """Drop the strongest side-tellers until the sides can no longer be told apart, or nothing more may be dropped.

    Rows are binned and dealt once for all rounds.
    Returns (columns, history of (round, auc, columns), whether the target was reached); ``rounds`` bounds the rounds.
    """
    current, history, sides = list(cols), [], Sides.of(a, b, cols, folds)
    while True:
        auc, imp = sides.auc(current, **kw)
        history.append((len(history), auc, len(current)))
        order = sorted(current, key=lambda c: (-imp[c], c))
        if enforce_protection:
            order = [c for c in order if c not in set(protected)]
        if auc <= target_auc or not order or len(current) <= step or len(history) == rounds:
            return current, history, auc <= target_auc
        current = [c for c in current if c not in order[:step]]


def tail_protected(df: DataFrame, cols: Sequence[str], y: str = "y", ratio: float = 2.0) -> list[tuple[str, float, float]]:
    """Columns at least ``ratio`` times as important on tail rows as on all rows."""
    q90 = fit_quantiles(df, {"y": (F.col(y), [0.9])})["y"][0]
    full = importances(fit_regressor(df, cols, y), cols)
    tail = importances(fit_regressor(df.where(F.col(y) >= q90), cols, y), cols)
    return [(c, full[c], tail[c]) for c in cols if (tail[c] + 1e-6) / (full[c] + 1e-6) > ratio]


# --- importance --------------------------------------------------------------------------------------------------


def shuffle_columns(df: DataFrame, cols: Sequence[str], key: str = "id", seed: int = 7) -> DataFrame:
    """The same rows with ``cols`` taken, together, from another row: two hash orders joined on position."""
    place = row_positions(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), [], ["_h", key], "_pos").drop("_h", *cols)
    donor = df.select(key, *cols).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed + 1)))
    return place.join(row_positions(donor, [], ["_h", key], "_pos").drop("_h", key), "_pos").drop("_pos")


def permutation_importance(model: PipelineModel, df: DataFrame, cols: Sequence[str], groups: Mapping[str, Sequence[str]], y: str = "y") -> dict[str, float]:
    """Rise of the mean absolute error when each named group of columns is shuffled."""
    base = mae(predict(model, df, cols, "_p"), y, "_p")
    return {n: mae(predict(model, shuffle_columns(df, g), cols, "_p"), y, "_p") - base for n, g in groups.items()}


def noise_columns(n: int, seed: int = 42, key: str = "id") -> dict[str, Column]:
    """Standard normal noise from hashes of the row's key, so that it does not depend on partitioning."""
    u = lambda i, k: (splits.unit_hash(F.col(key), F.lit(k), seed=seed + i) + F.lit(2.0**-32))
    return {f"__noise_{i}__": F.sqrt(-2.0 * F.ln(u(i, 1))) * F.cos(2.0 * F.pi() * u(i, 2)) for i in range(n)}


# --- stack, calibration -----------------------------------------------------------------------------------------


def ridge_stack(df: DataFrame, cols: Sequence[str], y: str, alpha: float = 1.0):
    """Ridge on unscaled inputs.  Spark's penalty is per row and divided by the label's std, hence alpha * std / n."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(y).alias("sd")).first()
    line = LinearRegression(labelCol=y, regParam=alpha * s.sd / s.n, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[assembler(cols), line]).fit(df)


def isotonic(df: DataFrame, p: str, label: str):
    """Monotone map from probability to observed rate; values outside the fitted range take its end values."""
    return IsotonicRegression(featuresCol=p, labelCol="_l", predictionCol="p_cal").fit(df.withColumn("_l", F.col(label).cast("double")))


def forest(df: DataFrame, cols: Sequence[str], label: str, trees: int = 20, depth: int = 5) -> PipelineModel:
    return Pipeline(stages=[assembler(cols), RandomForestClassifier(labelCol="_l", numTrees=trees, maxDepth=depth, seed=42)]).fit(
        with_sentinel(df, cols).withColumn("_l", F.col(label).cast("double"))
    )
