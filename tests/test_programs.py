"""Program mining on toy graphs, beta functions against closed forms, records and summaries."""

import itertools

import numpy as np
import pytest

from codepend import registry
from codepend.functions.betafn import beta_cdf, beta_ppf, ks_tail
from codepend.operators import annotate, programs, qc, significance


def graph_of(*groups):
    g = {}
    for a, b in itertools.chain.from_iterable(itertools.combinations(x, 2) for x in groups):
        g.setdefault(a, set()).add(b)
        g.setdefault(b, set()).add(a)
    return g


def test_beta():
    x = np.linspace(0.01, 0.99, 25)
    assert np.allclose(beta_cdf(x, 1, 1), x) and np.allclose(beta_cdf(x, 3, 1), x**3) and np.allclose(beta_cdf(x, 1, 4), 1 - (1 - x) ** 4)
    a, b = np.full(25, 2.5), np.full(25, 40.0)
    assert np.allclose(beta_cdf(beta_ppf(x, a, b), a, b), x, atol=1e-9)
    assert ks_tail(0.0, 10) == 1.0 and abs(ks_tail(1.36 / 10, 100) - 0.049) < 0.001


def test_fit_finds_a_beta():
    rng = np.random.RandomState(1)
    v = np.sort(rng.beta(3, 30, 400) * 0.5)
    a, b, c, mse, p = significance.fit_many([v])[0]
    assert mse < 0.001 and p > 0.01 and abs(a / (a + b) * c - v.mean()) < 0.01


def test_cliques_and_bridges():
    g = graph_of("abcdef", "fghijk", "kx")
    assert programs.maximum_cliques(g, g) == [list("abcdef"), list("fghijk")]
    assert programs.peel(g, "f", set(g)) == [list("abcdef"), list("fghijk")]
    assert programs.without_bridges(5, {(0, 1): 1, (1, 2): 1, (0, 2): 1, (2, 3): 1, (3, 4): 1}) == {(0, 1): 1, (1, 2): 1, (0, 2): 1}
    two = {(i, j): 1.0 for base in (0, 4) for i in range(base, base + 4) for j in range(i + 1, base + 4)} | {(3, 4): 0.1}
    assert programs.communities(9, two) == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]


def test_programs_of_planted_groups():
    g = graph_of("abcdefg", "hijklm", "gh")
    cliques = [c for s in g for c in programs.peel(g, s, set(g))]
    got = programs.find_programs(g, cliques)
    assert [p["program"] for p in got] == [list("abcdefg"), list("hijklm")]
    assert programs.evaluate(g, got)["overlap_ratio"] == 1.0
    assert programs.find_programs(g, []) == []


def test_merges():
    p = [(list("abcde"), {"x"}), (list("abcdf"), set()), (list("klmno"), set())]
    assert programs.merge_contained(p) == [(list("abcdef"), {"x"}), (list("klmno"), set())]


def test_false_discovery_ties_and_gaps(spark):
    rows = [("a", f"n{i}", p) for i, p in enumerate([0.001, 0.02, 0.02, 0.5, None, float("nan")])] + [("b", "n0", 0.9)]
    got = {(r["gene"], r["neighbor"]): r["significant"] for r in significance.false_discovery(spark.createDataFrame(rows, "gene string, neighbor string, p double")).collect()}
    assert got == {("a", "n0"): True, ("a", "n1"): True, ("a", "n2"): True, ("a", "n3"): False, ("b", "n0"): False}


def test_summaries_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, ["g1", "g2"], ["g2", "g3"])], "pid int, program array<string>, periphery array<string>")
    annotate.write_summaries(annotate.empty_summaries(p), str(tmp_path / "s"))
    got = annotate.read_summaries(spark, str(tmp_path / "s" / "with_genes")).collect()
    assert [(r["pid"], r["Genes"]) for r in got] == [(0, "g1, g2")]
    assert "| 0 |" in annotate.markdown(annotate.overview(p, spark.createDataFrame([(0, "t", "x")], "pid int, title string, n_bad string")))


def test_unknown_names_are_told(spark):
    from codepend.operators import activity

    with pytest.raises(ValueError):
        activity.eigen_loadings(None, None, "other")
    assert len(registry.queries()) > 100
    assert annotate.has_api_key(" sk-1") and not annotate.has_api_key("your key") and not annotate.has_api_key(None)
    assert [qc.working_name(x) for x in ([], ["a"], ["a", "b"])] == ["all", "a", "a_b"] and qc.working_name(["a"], "own") == "own"
