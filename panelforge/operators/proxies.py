"""How test-like parts of the training side are: one adversarial classifier a part, all against the same test side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from panelforge.operators import models as MO
from panelforge.operators.side_by_side import side_by_side


def adversarial_table(spark: SparkSession, parts: Mapping[str, DataFrame], test: DataFrame, cols: Sequence[str], **kw) -> DataFrame:
    """(part, n_rows, adv_auc_vs_test, status, place): place 1 is the part hardest to tell from the test side, ties by name.

    Parts may overlap. A part without rows, or any part against an empty test side, has no AUC, status or place. The fits run side by side.
    """
    sizes = side_by_side([part.count for part in parts.values()])
    n_test = test.count()
    known = [name for name, n in zip(parts, sizes) if n and n_test]
    found = dict(zip(known, side_by_side([partial(MO.adversarial_auc, parts[name], test, cols, **kw) for name in known])))
    rows = [(name, n, found[name][0] if name in found else None) for name, n in zip(parts, sizes)]
    out = spark.createDataFrame(rows, "part string, n_rows long, adv_auc_vs_test double")
    auc = F.col("adv_auc_vs_test")
    place = F.row_number().over(W.orderBy(auc.asc_nulls_last(), "part"))  # one row a part
    return out.withColumns({"status": F.when(auc.isNotNull(), MO.shift_status(auc)), "place": F.when(auc.isNotNull(), place)})
