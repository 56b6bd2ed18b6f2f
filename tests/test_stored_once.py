"""Queries on the customer x brand matrix evaluate the joins behind it once; percentiles are exact whatever the ranges."""

import numpy as np
import pytest

from codepend import registry
from codepend.operators.ranks import percentiles
from codepend.queries import activity, common

DIR = "/root/testdata/sf0.001"
NAMES = ("b21_min_observations", "e03_plane", "e06_centroids_medoids", "e07_quartiles_by_type", "t01_eigen_residuals", "t03b_clipped_robust_zscore", "t03h_robust_zscore_trimmed", "t03l_quantile")


@pytest.fixture
def shared(spark, tmp_path):
    sc = spark.sparkContext
    sc.setCheckpointDir(str(tmp_path / "shared"))
    yield
    getattr(sc._jsc.sc(), "checkpointDir_$eq")(sc._jvm.scala.Option.empty())


@pytest.mark.parametrize("name", NAMES)
def test_joins_run_once(spark, shared, monkeypatch, name):
    calls, real = [], common.customer_brand
    for module in (common, activity):
        monkeypatch.setattr(module, "customer_brand", lambda *a: calls.append(a) or real(*a))
    got = registry.queries()[name](spark, DIR)
    assert len(calls) == 1
    assert not [f for f in got.inputFiles() if "lineitem" in f]


def test_percentiles_of_many_values(spark):
    x = np.round(np.random.default_rng(1).normal(size=4000), 2).tolist() + [None] * 5 + [0.0] * 700
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(x)], "g int, x double")
    got = {r["g"]: r["q"] for r in percentiles(df, "x", (0.0, 0.25, 0.501, 1.0), ["g"]).collect()}
    for g in (0, 1):
        own = [v for i, v in enumerate(x) if i % 2 == g and v is not None]
        assert np.allclose(got[g], np.percentile(own, (0, 25, 50.1, 100)), atol=1e-12)
