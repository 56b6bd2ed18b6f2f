"""The analysis end to end on planted blocks, and streamed moments."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codepend.operators import dependence, layout, qc, ranks
from codepend.plans import pipeline
from codepend.streaming import moments


def planted(spark, path, cells=1200, genes=150, blocks=2, size=3):
    """Blocks stay at 2 % of the genes: the moment fit can't trim more, and loses larger ones."""
    rng = np.random.RandomState(42)
    rate = np.tile(rng.gamma(2, 1, genes), (cells, 1))
    for b in range(blocks):
        on = rng.rand(cells) < 0.25
        rate[:, b * size : (b + 1) * size] *= np.where(on, 4, 0.5)[:, None]
    x = rng.poisson(rate / rate.sum(1, keepdims=True) * rng.uniform(800, 1600, cells)[:, None])
    i, j = np.nonzero(x)
    import pandas as pd

    spark.createDataFrame(pd.DataFrame({"cell_id": i.astype("int64"), "gene": [f"g{k:03d}" for k in j], "x": x[i, j].astype(float)})).write.parquet(f"{path}/counts")
    spark.range(cells).select(F.col("id").alias("cell_id"), F.lit("t").alias("cell_type"), F.when(F.col("id") < cells // 3, "one").otherwise("two").alias("source")).write.parquet(f"{path}/cells")


def test_planted_blocks_are_found(spark, tmp_path):
    planted(spark, str(tmp_path / "m"))
    config = pipeline.load_config(json.dumps({"global": {"cooccurrence_threshold": 20}, "preprocess": {"umi": 1e9, "mt": 100, "nonzero": 0}, "report_plots": {"leiden_resolution": 0.7}, "llm": {"api_key": "sk-x"}, "other": {"least_neighbours": 20, "clique_size": 3, "unknown": 1}}))
    assert config.resolution_of_clusters == 0.7
    ask = lambda p: "Title: Of " + p.split("'")[1] + "\nInconsistent Genes: g000, none such\nSummary: Line\nEvidence: $ \"x\""
    took = pipeline.run(spark, str(tmp_path / "m"), str(tmp_path / "o"), config, ask=ask, template="{positively_loaded_genes} and not {negatively_loaded_genes} {{x}}")
    assert list(took) == list(pipeline.STEPS)
    got = [set(r["program"]) for r in spark.read.parquet(str(tmp_path / "o" / "programs")).collect()]
    want = [{f"g{k:03d}" for k in range(b * 3, b * 3 + 3)} for b in range(2)]
    for w in want:
        assert any(w <= g for g in got), got
    read = lambda name: spark.read.parquet(str(tmp_path / "o" / name))
    assert read("wepas").where("high").count() > 0 and read("sepas").columns == ["cell_id", "pid", "raw", "x", "high"]
    stats = {r["pid"]: r for r in read("wepas_stats").collect()}
    assert stats[0]["n_high"] == read("wepas").where("pid = 0 and high").count() and stats[0]["G_total"] == read("programs").where("pid = 0").first()["program"].__len__()
    fits = read("fits").count()
    assert read("fits_kept").count() + read("fits_excluded").count() == fits > 0
    assert {(r["source"], r["chunk_id"]) for r in read("cells").select("source", "chunk_id").distinct().collect()} == {("one", 1), ("two", 2)}
    assert read("embedding").count() == read("clusters").count() == read("cells").count()
    assert json.loads(read("metrics").first()["json"])["program_count"] == read("programs").count() and read("stage2").count() > 0
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "o" / "report"), wholetext=True).collect())
    assert "## Program 0: Of g00" in text and 'Evidence: $ "x"' in text and "Number of Cells: 1" in text and "| total |" in text
    raw = "".join(r["value"] for r in spark.read.text(str(tmp_path / "o" / "summaries" / "with_genes"), wholetext=True).collect())
    assert raw.startswith('\ufeff"Program"$"Title"$"Genes"') and '"Program 0"$"Of g00' in raw
    again = pipeline.run(spark, str(tmp_path / "m"), str(tmp_path / "o"), config, skip=tuple(s for s in pipeline.STEPS if s != "report"))
    assert list(again) == ["report"] and read("summary_rows").first()["Title"] == ""


def test_streamed_moments(spark, tmp_path):
    planted(spark, str(tmp_path / "m"), 60, 12, 1, 3)
    counts = spark.read.parquet(str(tmp_path / "m" / "counts"))
    for k in range(3):
        counts.where(f"cell_id % 3 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in[0-9]"))
    moments.follow(stream, str(tmp_path / "sums"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r["gene"]: r for r in moments.totals(spark.read.parquet(str(tmp_path / "sums")), 60).collect()}
    for r in dependence.gene_moments(dependence.normalised(counts), 60).collect():
        assert abs(got[r["gene"]]["mean"] - r["mean"]) < 1e-12 and abs(got[r["gene"]]["std"] - r["std"]) < 1e-9


def test_blocked_pairs_of_wide_matrices(spark, tmp_path):
    """Tiles give what the join gives, whatever the tile."""
    planted(spark, str(tmp_path / "m"), 150, 90)
    m = pipeline.read_matrix(spark, str(tmp_path / "m"))
    p = dependence.normalised(m.counts)
    y = dependence.scaled(p, dependence.gene_moments(p, 150).select("gene", F.col("top").alias("clip_val"))).cache()
    want = {(r["g1"], r["g2"]): r for r in dependence.pairs(y, 150).collect()}
    for tile in (16, 256):
        got = {(r["g1"], r["g2"]): r for r in dependence.blocked_pairs(y.repartition(5), 150, tile).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r["cooc"] == want[k]["cooc"] and abs(r["ids"] - want[k]["ids"]) < 1e-9 and abs(r["corr"] - want[k]["corr"]) < 1e-9


def test_ranks_and_percentiles_by_numpy(spark):
    rng = np.random.RandomState(5)
    rows = [(g, float(v), i) for g, n in (("a", 1000), ("b", 7), ("c", 1)) for i, v in enumerate(np.where(rng.rand(n) < 0.4, 0.0, rng.normal(0, 1, n)))]
    df = spark.createDataFrame(rows + [("a", None, -1), ("d", None, 0)], "g string, v double, id int").repartition(6)
    by = {g: [v for h, v, _ in rows if h == g] for g in "abc"}
    for parts in (2, 50):
        got = {r["g"]: r["q"] for r in ranks.percentiles(df, "v", (0.0, 0.25, 0.5, 0.99, 1.0), ["g"], parts).collect()}
        assert got.keys() == by.keys()
        for g, v in by.items():
            assert np.allclose(got[g], np.percentile(v, [0, 25, 50, 99, 100]))
        place = {(r["g"], r["id"]): (r["rank"], r["size_"]) for r in ranks.ranked(df.where("v is not null"), "v", "id", ["g"], parts=parts).collect()}
        for g, v in by.items():
            order = sorted(range(len(v)), key=lambda i: (v[i], i))
            assert all(place[g, i] == (k + 1, len(v)) for k, i in enumerate(order))
    assert ranks.percentiles(df.where("g = 'd'"), "v", (0.5,)).collect() == []


def test_count_above_range_raises(spark):
    with pytest.raises(Exception, match="above 65535"):
        qc.guarded(spark.createDataFrame([(1, "g", 65536.0)], "cell_id long, gene string, x double")).collect()


def test_neighbours_in_several_lists(spark):
    """Lists and blocks: recall against all pairs, and exact where every list is searched."""
    rng = np.random.RandomState(6)
    x = rng.normal(0, 1, (900, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :5]
    for lists, probes, least in ((1, 1, 1.0), (6, 6, 1.0), (6, 3, 0.9)):
        got: dict = {}
        for r in layout.nearest(df, 5, lists, probes).collect():
            got.setdefault(r["id"], []).append(r["neighbor"])
        assert np.mean([len(set(got[i]) & set(w)) / 5 for i, w in enumerate(want)]) >= least
    far = spark.createDataFrame([(i, [float(i % 2 * 50), float(i % 7)]) for i in range(200)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in layout.clusters(far, layout.nearest(far, 5), lists=10).collect()}
    assert not {got[i] for i in range(0, 200, 2)} & {got[i] for i in range(1, 200, 2)}
    flat = {r["id"]: (r["x"], r["y"]) for r in layout.plane(far).collect()}
    assert flat[1][0] - flat[0][0] > 49 and layout.leaf_order(np.eye(1)) == [0]
