"""Ranks, running totals and quantiles against NumPy and pandas, with hot keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import ordering


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 3000
    group = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    value = np.round(np.where(rng.random(n) < 0.3, 5.0, rng.normal(0, 50, n)), 2)
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "v": value, "w": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf)


def test_blocks_are_many(frame):
    _, df = frame
    laid = ordering.lay_out(df, [F.col("v"), F.col("id")])
    assert laid.select("_block").distinct().count() > 1


def test_global_rank(frame):
    pdf, df = frame
    ranked = ordering.global_rank(df, [F.col("v").desc(), F.col("id")]).toPandas()
    expected = pdf.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert ranked.sort_values("rank")["id"].tolist() == expected
    assert sorted(ranked["rank"]) == list(range(1, len(pdf) + 1))


def test_rank_within_groups(frame):
    pdf, df = frame
    ranked = ordering.global_rank(df, [F.col("v"), F.col("id")], by=["g"]).toPandas()
    ordered = pdf.sort_values(["g", "v", "id"])
    ordered["rank"] = ordered.groupby("g").cumcount() + 1
    joined = ranked.merge(ordered[["id", "rank"]], on="id")
    assert (joined["rank_x"] == joined["rank_y"]).all()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(frame, by):
    pdf, df = frame
    got = ordering.running_totals(
        df, [F.col("v"), F.col("id")], {"up": F.col("w")}, by, sizes={"all": "up"}
    ).toPandas()
    ordered = pdf.sort_values([*by, "v", "id"])
    groups = ordered.groupby(by)["w"] if by else ordered["w"]
    ordered["up"] = groups.cumsum()
    ordered["all"] = groups.transform("sum") if by else ordered["w"].sum()
    joined = got.merge(ordered[["id", "up", "all"]], on="id")
    assert (joined["up_x"] == joined["up_y"]).all()
    assert (joined["all_x"] == joined["all_y"]).all()


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(frame, by):
    pdf, df = frame
    wanted = {"lo": 0.001, "q1": 0.25, "mid": 0.5, "hi": 0.999}
    got = ordering.quantiles(df, "v", wanted, by).toPandas()
    for _, row in got.iterrows():
        values = pdf if not by else pdf[pdf["g"] == row["g"]]
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values["v"], p), abs=1e-9)
    assert len(got) == (pdf["g"].nunique() if by else 1)


def test_null_groups_and_values(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 3.0), ("x", None), ("x", 4.0)], "g string, v double"
    )
    got = {r["g"]: r["m"] for r in ordering.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: 2.0, "x": 4.0}


def test_average_ranks(frame):
    pdf, df = frame
    got = ordering.average_ranks(df, "v").toPandas().set_index("v")["average_rank"]
    expected = pdf["v"].rank()
    assert np.allclose(pdf["v"].map(got), expected)


@pytest.mark.parametrize("rows_per_slice", [1, 5, 1_000_000])
def test_spread_lookup(frame, rows_per_slice):
    """Keys above the number of rows are spread over as many slices as that takes."""
    pdf, df = frame
    ranks = ordering.average_ranks(df, "v").select("v", "n", "average_rank")
    joined = ordering.spread_lookup(df, ranks, ["v"], "n", rows_per_slice)
    assert joined.count() == len(pdf)
    assert joined.agg(F.sum("average_rank")).head()[0] == pytest.approx(pdf["v"].rank().sum())
