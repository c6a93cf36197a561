"""Ranks of many columns at a time against brute force, with ties, unknown values, unknown groups and large groups."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import ranks
from panelforge.plans.drift_audit import directional_conflict


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    n = 3_000
    pdf = pd.DataFrame({"id": np.arange(n), "sid": [None if i % 50 == 0 else float(i % 40 if i % 3 else 0) for i in range(n)], "y": rng.normal(size=n)})
    pdf["few"] = np.round(pdf.y + rng.normal(size=n))
    pdf["many"] = rng.normal(size=n) - 0.3 * pdf.y
    pdf["gaps"] = np.where(np.arange(n) % 4 == 0, np.nan, np.round(pdf.y, 1))
    return pdf


def as_frame(spark, pdf, schema):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)], schema)


SCHEMA = "id long, sid double, y double, few double, many double, gaps double"


@pytest.mark.parametrize("sent", [0, 100_000])
def test_columns_known_in_the_same_rows_share_the_ranks_of_y(spark, many_ranges, monkeypatch, table, sent):
    """One value table ranks y for all complete columns; a column with gaps has ranks of its own rows."""
    monkeypatch.setattr(ranks, "SENT_VALUES", sent)
    scans, scan = [], ranks.prefix_scan
    monkeypatch.setattr(ranks, "prefix_scan", lambda *a, **k: scans.append(1) or scan(*a, **k))
    got = ranks.rank_correlations(as_frame(spark, table, SCHEMA), ["few", "many", "gaps"], "y").toPandas().set_index("feature")
    assert len(scans) == 2
    for c in ("few", "many", "gaps"):
        known = table[table[c].notna()]
        assert np.isclose(got.pearson[c], known[c].corr(known.y)) and np.isclose(got.spearman[c], known[c].rank().corr(known.y.rank()))


@pytest.mark.parametrize("limit", [100, 100_000])
def test_ranks_inside_groups_do_not_depend_on_their_size(spark, many_ranges, monkeypatch, table, limit):
    monkeypatch.setattr(ranks, "GROUP_ROWS", limit)
    got = ranks.tie_ranks_of_columns(as_frame(spark, table, SCHEMA), "sid", ["few", "many", "gaps"]).toPandas().sort_values("id")
    want = table.assign(sid=table.sid.fillna(-1.0)).groupby("sid")
    assert len(got) == len(table)
    for c in ("few", "many", "gaps"):
        assert np.allclose(got[f"_rank_{c}"].to_numpy(dtype=float), want[c].rank().to_numpy(), equal_nan=True)


def test_an_unknown_group_takes_part_in_the_conflict(spark, table):
    """The SQL counts the NULL sequence too, and ranks the label in the rows that know the column."""
    pdf = table.assign(t=(table.y > 0.8).astype(float))
    df = as_frame(spark, pdf[["sid", "t", "few", "gaps"]], "sid double, t double, few double, gaps double")
    got = directional_conflict(df, ["few", "gaps"]).toPandas().set_index("feature")
    for c in ("few", "gaps"):
        known = pdf[pdf[c].notna()].assign(sid=pdf.sid.fillna(-1.0))
        rho = known.groupby("sid").apply(lambda g: g[c].rank().corr(g.t.rank())).dropna()
        assert got.n[c] == len(rho) and np.isclose(got.pos_ratio[c], (rho > 0.2).mean(), atol=1e-6) and np.isclose(got.neg_ratio[c], (rho < -0.2).mean(), atol=1e-6)
