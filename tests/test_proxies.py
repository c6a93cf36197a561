"""The part that looks like the test side comes first, a shifted one last; parts without rows have no verdict."""

import numpy as np
import pandas as pd

from panelforge.operators import proxies as PX
from panelforge.session import cut_lineage


def test_parts_are_placed_by_how_test_like_they_are(spark):
    g = np.random.default_rng(2)

    def rows(first, shift):
        return cut_lineage(spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + 600), "a": g.normal(size=600) + shift, "b": g.normal(size=600)})))

    test, near, far = rows(0, 0.0), rows(1000, 0.0), rows(2000, 4.0)
    got = PX.adversarial_table(spark, {"far": far, "none": far.limit(0), "near": near}, test, ["a", "b"]).toPandas().set_index("part")
    assert got.loc["near", "status"] == "SAFE_PROXY" and got.loc["near", "place"] == 1
    assert got.loc["far", "adv_auc_vs_test"] > 0.95 and got.loc["far", "status"] == "SEVERE_SHIFT" and got.loc["far", "place"] == 2
    assert got.loc["none", "n_rows"] == 0 and got.loc["none", ["adv_auc_vs_test", "status", "place"]].isna().all()
    empty = PX.adversarial_table(spark, {"near": near}, test.limit(0), ["a", "b"]).first()
    assert (empty.n_rows, empty.adv_auc_vs_test, empty.status, empty.place) == (600, None, None, None)
