"""The analysis as one run over a stored matrix: quality control, ceilings, dependence, significance, programs, activity, report.

Each step writes Parquet tables under `out` and the next reads them, so a lost executor, or a later
run that skips steps, starts from tables.

| table | content |
|-|-|
| cells, counts | what passed, by source where cells have one; chunk_id numbers at most 100,000 cells of a source |
| genes, gene_stats, pairs | the gene axis, ceilings, dependence |
| fits, fits_kept, fits_excluded, edges | significance |
| cliques, stage2, programs, program_json, metrics | programs and the stages before |
| loadings, loadings_json, wepas, wepas_stats, sepas, sepas_stats | activity: raw and scaled values, calls, thresholds |
| embedding, clusters, correlation, quartiles, heat_map | what figures would show |
| summaries, report | one row for each program; the report as Markdown |
"""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, annotate, dependence, graph, layout, programs, qc, ranks, significance
from ..sources.tables import Matrix, read_matrix, stored

LOG = logging.getLogger(__name__)
STEPS = ("qc", "ceilings", "pairs", "fits", "edges", "programs", "activity", "report")


@dataclass(frozen=True)
class Config:
    cell_types: list[str] = field(default_factory=list)
    cooccurrence_threshold: int = 100
    filter_raw_data: bool = True
    umi: float = 30000
    nonzero: float = 1
    mt: float = 99
    prefix: str = "MT-"
    top_k_percentage: float = 1
    least_neighbours: int = 100
    mse_threshold: float = 0.01
    p_val: float = 0.05
    max_significant_neighbors: int = 1000
    clique_size: int = 5
    growth: float = 0.9
    resolution: float = 1.0
    containment: float = 0.7
    loading_type: str = "ids_eig"
    program_vector_scaling: str = "curvature_clip"
    weighting: str = "positive"
    resolution_of_clusters: float = 0.5
    api_key: str = ""
    provide_celltype: bool = False
    wide_from: int = dependence.WIDE_FROM  # genes from which on dependence is summed by tiles


def load_config(text: str) -> Config:
    """Two-level JSON: a setting may stand in any section."""
    known = {f.name for f in fields(Config)}
    names = {"leiden_resolution": "resolution_of_clusters"}
    given = {names.get(k, k): v for part in json.loads(text).values() for k, v in part.items()}
    return Config(**{k: v for k, v in given.items() if k in known})


def run(spark: SparkSession, matrix: str, out: str, config: Config | None = None, skip: tuple[str, ...] = (), ask=None, template: str | None = None) -> dict[str, float]:
    """Run the steps that aren't skipped; seconds by step. ask: a callable from a prompt to a reply, used if the configuration has a key."""
    c, took = config or Config(), {}

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{out}/{name}")

    def write(name: str, df: DataFrame, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{out}/{name}")

    def kept() -> tuple[Matrix, int]:
        m = Matrix(table("cells"), table("counts"))
        return m, m.cells.count()

    def y_of(m: Matrix) -> DataFrame:
        return dependence.scaled(dependence.normalised(m.counts), table("gene_stats"))

    def step_qc() -> None:
        m = read_matrix(spark, matrix)
        cells = qc.of_types(qc.labelled(m.cells), c.cell_types)
        m = Matrix(cells, m.counts)
        if c.filter_raw_data:
            q = qc.cell_metrics(m, c.prefix)
            cells = cells.join(qc.passing(q, qc.thresholds(q, c.nonzero, c.mt), c.umi).select("cell_id"), "cell_id", "left_semi")
        by = "source" if "source" in cells.columns else None
        if by:
            passed = {r[by] for r in cells.select(by).distinct().toLocalIterator()}  # a value for each input
            for r in m.cells.select(by).distinct().toLocalIterator():
                if r[by] not in passed:
                    LOG.warning("no cells passed of %s", r[by])
        write("cells", qc.chunked(cells if by else cells.withColumn("source", F.lit("all")), "source"), by)
        write("genes", qc.gene_axis(m.counts))
        write("counts", qc.guarded(m.counts.join(table("cells").select("cell_id"), "cell_id", "left_semi")).withColumn("x", F.col("x").cast("double")))

    def step_ceilings() -> None:
        m, n = kept()
        write("gene_stats", dependence.ceilings(dependence.normalised(m.counts), n, c.top_k_percentage, c.cooccurrence_threshold))

    def step_pairs() -> None:
        m, n = kept()
        wide = table("genes").count() >= c.wide_from
        write("pairs", (dependence.blocked_pairs if wide else dependence.pairs)(y_of(m), n).withColumn("ids", dependence.truncated(F.col("ids"))))

    def step_fits() -> None:
        write("fits", significance.significance(table("pairs"), c.cooccurrence_threshold, c.least_neighbours, c.p_val))

    def step_edges() -> None:
        judged = significance.acceptable(table("fits"), c.mse_threshold, c.max_significant_neighbors)
        write("fits_kept", judged.where("kept").drop("kept"))
        write("fits_excluded", judged.where("not kept").drop("kept"))
        write("edges", significance.undirected(significance.directed_edges(table("fits"), c.mse_threshold, c.max_significant_neighbors)))

    def step_programs() -> None:
        edges = table("edges")
        hits = significance.acceptable(table("fits"), c.mse_threshold, c.max_significant_neighbors).where("kept").select("gene", F.explode("significant_hit_genes").alias("neighbor"))
        write("cliques", programs.seed_cliques(edges, hits, c.clique_size))
        near: programs.Graph = {}
        for r in edges.toLocalIterator():  # vertices are genes, not cells
            near.setdefault(r["a"], set()).add(r["b"])
        groups, weights = graph.clique_graph(table("cliques"), edges)
        stage2 = programs.stage_two(near, groups, weights, c.clique_size, c.resolution) if groups else []
        found = programs.find_programs(near, groups, c.clique_size, c.growth, c.resolution, c.containment, weights)
        figures = programs.evaluate(near, found)
        LOG.info("programs: %s", figures)
        clique = "genes array<string>, size int, density double, periphery array<string>"
        write("stage2", spark.createDataFrame([(s["community"], s["core"], s["cliques"][1:], s["penumbra"], s["total_size"], s["num_input_cliques"]) for s in stage2], f"community_id int, core_genes array<string>, cliques array<struct<{clique.replace(' ', ':').replace(',:', ',')}>>, penumbra_genes array<string>, total_size int, num_input_cliques int"))
        write("metrics", spark.createDataFrame([(json.dumps(figures),)], "json string"))
        write("programs", spark.createDataFrame([(k, p["program"], p["periphery"]) for k, p in enumerate(found)], "pid int, program array<string>, periphery array<string>"))
        write("heat_map", spark.createDataFrame([(k, *x) for k, x in enumerate(programs.heat_order(near, [p["program"] for p in found]))], "place int, pid int, gene string"))
        write("program_json", annotate.program_json(table("programs")))

    def step_activity() -> None:
        m, n = kept()
        members = table("programs").select("pid", F.explode("program").alias("gene"))
        write("loadings", activity.eigen_loadings(table("pairs"), members, c.loading_type))
        loadings = table("loadings")
        write("loadings_json", annotate.loadings_json(loadings))
        write("y", y_of(m))  # read by both scores
        sizes = loadings.groupBy("pid").agg(F.count(F.lit(1)).alias("genes"))
        for name, nonzero in (("wepas", False), ("sepas", True)):
            if nonzero:
                raw = activity.co_expression(table("y"), m.cells, n, loadings, c.weighting)
            else:
                raw = activity.weighted(table("y"), m.cells, loadings)
            write(f"{name}_raw", raw)
            raw = table(f"{name}_raw")
            scaled = raw if nonzero else stored(activity.scaled_activity(raw, c.program_vector_scaling, sizes, n))
            calls, thresholds = activity.with_calls(raw, scaled, nonzero)
            write(name, calls)
            write(f"{name}_stats", activity.program_stats(table(name), thresholds, loadings))

    def step_report() -> None:
        m, n = kept()
        shown = activity.plotted(table("wepas"))
        points = layout.matrix_of(shown)
        write("embedding", layout.plane(points))
        write("clusters", layout.clusters(points, layout.nearest(points), c.resolution_of_clusters))
        x, y = shown.select("cell_id", F.col("pid").alias("i"), F.col("x").alias("u")), shown.select("cell_id", F.col("pid").alias("j"), F.col("x").alias("v"))
        write("correlation", x.join(y, "cell_id").groupBy("i", "j").agg(F.corr("u", "v").alias("r")))
        q = ranks.percentiles(shown.join(table("clusters").withColumnRenamed("id", "cell_id"), "cell_id"), "x", (0.25, 0.5, 0.75), ["pid", "cluster"])
        write("quartiles", q.select("pid", "cluster", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3")))
        types = sorted(r["cell_type"] for r in m.cells.select("cell_type").distinct().toLocalIterator())
        if ask is not None and annotate.has_api_key(c.api_key):
            rows = annotate.summaries(table("loadings"), ask, template, types if c.provide_celltype else None)
        else:
            rows = annotate.empty_summaries(table("programs"))
        write("summary_rows", rows)  # every program is asked for once
        annotate.write_summaries(table("summary_rows"), f"{out}/summaries")
        info = {"Cell Type(s)": ", ".join(c.cell_types or types), "Number of Cells": n, "Number of Genes": table("genes").count()}
        text = annotate.report(table("programs"), annotate.read_summaries(spark, f"{out}/summaries/with_genes"), info, table("quartiles"))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")

    steps = {"qc": step_qc, "ceilings": step_ceilings, "pairs": step_pairs, "fits": step_fits, "edges": step_edges, "programs": step_programs, "activity": step_activity, "report": step_report}
    for name in STEPS:
        if name not in skip:
            began = time.time()
            steps[name]()
            took[name] = time.time() - began
            LOG.info("%s: %.1f s", name, took[name])
    return took
