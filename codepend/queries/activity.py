"""Activity (G16, G17, J09, T01-T06, T03a-l, W07, W11-W13). Programs are runs of eight brands, loadings a rule of the brand's number."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import activity as act
from ..operators import dependence as dep
from ..operators import layout as lay
from ..registry import query
from ..sources.tables import customer_brand, stored
from .common import Y, customer_p, customer_pairs, customer_y, rounded, sql

LOAD = Y + ", load as (select gene, ((substr(gene, 7)::integer - 1) // 8)::integer as pid, (substr(gene, 7)::integer % 5 - 1) / 5e0 as w from (select distinct gene from counts))"
ACT = LOAD + """, g as (select pid, count(*) as g, count(*) filter (w >= 0) as gp from load group by pid), s as (select cell_id, pid, sum(y * w) as s from y join load using (gene) group by all),
act as (select cells.cell_id, g.pid, round(coalesce(s, 0) / sqrt(g), 6) + 0.0 as x from cells cross join g left join s on s.cell_id = cells.cell_id and s.pid = g.pid)"""
Q = ACT + ", q as (select pid, quantile_cont(x, 25e-2) as q1, quantile_cont(x, 5e-1) as med, quantile_cont(x, 75e-2) as q3, avg(x) as mean, stddev_pop(x) as std, min(x) as lo, max(x) as hi, count(*) as n from act group by pid)"
TAIL = LOAD + ", nge as (select cell_id, gene, count(*) over (partition by gene order by ry desc range unbounded preceding) as k from (select *, round(y, 6) as ry from y)), tail as (select cell_id, gene, case when k / n <= 5e-2 then -log10(k / n) else 0 end as t from nge, n)"
OTSU = """span as (select pid, min(x) as lo, max(x) as hi, count(*) as n from act group by pid),
bins as (select pid, bin, any_value(lo) + (bin + 5e-1) * (any_value(hi) - any_value(lo)) / 256 as c, count(*) / any_value(n) as w from (select pid, least(floor((x - lo) / (hi - lo) * 256), 255) as bin, lo, hi, n from act join span using (pid)) group by pid, bin),
cum as (select *, sum(w) over up as cw, sum(w * c) over up as cm, sum(w * c) over (partition by pid) as mt from bins window up as (partition by pid order by bin)),
thr as (select pid, c as threshold from (select *, case when cw * (1 - cw) <= 1e-12 then 0 else round((mt * cw - cm) ** 2 / (cw * (1 - cw)), 12) end as sigma from cum) qualify row_number() over (partition by pid order by sigma desc, bin) = 1)"""


def _loadings(spark, d, counts=None):
    genes = (customer_brand(spark, d).counts if counts is None else counts).select("gene").distinct()
    nr = F.expr("int(substring(gene, 7))")
    return genes.select("gene", F.floor((nr - 1) / 8).cast("int").alias("pid"), ((nr % 5 - 1) / 5.0).alias("w"))


def _projected(spark, d):
    """The matrix, its activity, kept as a table for several readers, and the loadings, all from one evaluation of the joins."""
    m, y, _ = customer_y(spark, d)
    load = stored(_loadings(spark, d, m.counts))
    return m, stored(rounded(act.weighted(y, m.cells, load))), load


def _activity(spark, d):
    return _projected(spark, d)[1]


def _points(spark, d):
    return stored(lay.matrix_of(_activity(spark, d)))


@query("g16_libraries", sql("r as (select cells.cell_id, coalesce(sum(x), 0)::double as lib from cells left join counts on cells.cell_id = counts.cell_id group by 1)", "lib", "cell_id"))
def g16(spark, d):
    m = customer_brand(spark, d)
    lib = m.counts.groupBy("cell_id").agg(F.sum("x").alias("lib"))
    return rounded(m.cells.join(lib, "cell_id", "left").select("cell_id", F.coalesce("lib", F.lit(0.0)).alias("lib")))


@query("g17_program_counts", sql(ACT + "," + OTSU + ", r as (select act.pid, count(*) filter (x > threshold) as n_high, any_value(gp) as \"G\", any_value(g) as \"G_total\" from act join thr on act.pid = thr.pid join g on g.pid = act.pid group by 1)", "", 'pid n_high "G" "G_total"'))
def g17(spark, d):
    _, a, load = _projected(spark, d)
    return act.program_counts(act.high_calls(a, act.otsu(a)), load)


@query("j09_program_genes", sql(LOAD + ", r as (select cell_id, gene, y, pid, w from y join load using (gene) where pid = 1)", "y w", "cell_id gene pid"))
def j09(spark, d):
    m, y, _ = customer_y(spark, d)
    return rounded(y.join(F.broadcast(_loadings(spark, d, m.counts).where("pid = 1")), "gene").select("cell_id", "gene", "y", "pid", "w"))


@query("t01_eigen_loadings")
def t01(spark, d):
    return act.eigen_loadings(customer_pairs(spark, d), _loadings(spark, d).select("pid", "gene"))


@query("t01_corr_loadings")
def t01c(spark, d):
    return act.eigen_loadings(customer_pairs(spark, d), _loadings(spark, d).select("pid", "gene"), "corr_eig")


@query("t02_weighted_activity", sql(ACT + ", r as (select * from act)", "x", "cell_id pid"))
def t02(spark, d):
    return _activity(spark, d)


_Z = "(x - med) / (case when q3 = q1 then 1 else q3 - q1 end / 1349e-3)"
_CLIP = lambda c, k: f"greatest(-{k}, least({k}, {c}))"
_S = "(x - mean) / case when std = 0 then 1 else std end"
_D = lambda a: f"case when i = 0 then (-3 * {a} + 4 * lead({a}, 1) over w_ - lead({a}, 2) over w_) / (2 * h) when i = r - 1 then (3 * {a} - 4 * lag({a}, 1) over w_ + lag({a}, 2) over w_) / (2 * h) else (lead({a}, 1) over w_ - lag({a}, 1) over w_) / (2 * h) end"
_CURVE = Q + f""", zs as (select cell_id, pid, {_S} as z, n from act join q using (pid)), tops as (select * from (select *, row_number() over (partition by pid order by z desc, cell_id) as rank from zs) where rank <= ceil(n * 1e-2)),
e0 as (select pid, z, rank - 1 as i, count(*) over g as r, (z - min(z) over g) / (max(z) over g - min(z) over g + 1e-12) as y0, 1 / (count(*) over g - 1 + 1e-12) as h from tops window g as (partition by pid)),
e1 as (select *, {_D('y0')} as y1 from e0 where r >= 3 window w_ as (partition by pid order by i)), e2 as (select *, {_D('y1')} as y2 from e1 window w_ as (partition by pid order by i)),
bend as (select pid, z as cap from e2 qualify row_number() over (partition by pid order by abs(y2) / (1 + y1 * y1) ** 15e-1 desc, i) = 1),
r as (select cell_id, zs.pid, coalesce(least(z, cap), z) * sqrt(g) as x from zs join g on zs.pid = g.pid left join bend on bend.pid = zs.pid)"""
_FORMS = {
    "iqr": "(x - q1) / case when q3 = q1 then 1 else q3 - q1 end",
    "clipped_robust_zscore": _CLIP(_Z, 5),
    "clipped_raw_activity": _CLIP("x", 8),
    "clipped_zscore": _CLIP(_S, 5),
    "robust_zscore": _Z,
    "robust_zscore_symlog": f"sign({_Z}) * ln(1 + abs({_Z}))",
    "robust_zscore_symsqrt": f"sign({_Z}) * sqrt(abs({_Z}))",
    "min_max": "(x - lo) / case when hi = lo then 1 else hi - lo end",
}
_TEXT = {k: Q + f", r as (select cell_id, pid, {v} as x from act join q using (pid))" for k, v in _FORMS.items()}
_TEXT["curvature_clip"] = _CURVE
_TEXT["subpop_trim"] = Q + ", kth as (select pid, x as kth from act qualify row_number() over (partition by pid order by x desc) = 100), c as (select q.pid, lo, case when n > 100 then kth else hi end as cap from q left join kth on q.pid = kth.pid), r as (select cell_id, pid, (least(x, cap) - lo) / case when cap = lo then 1 else cap - lo end as x from act join c using (pid))"
_TEXT["robust_zscore_trimmed"] = Q + f", mad as (select pid, quantile_cont(abs(x - med), 5e-1) as mad from act join q using (pid) group by pid), r as (select cell_id, pid, {_CLIP('(x - med) / case when mad = 0 then 1 else 14826e-4 * mad end', 8)} as x from act join q using (pid) join mad using (pid))"
_TEXT["quantile"] = Q + ", nz as (select cell_id, pid, row_number() over (partition by pid order by x, cell_id) / (count(*) over (partition by pid) + 1) as r from act where x <> 0), r as (select act.cell_id, act.pid, coalesce(r, 0) as x from act left join nz on nz.cell_id = act.cell_id and nz.pid = act.pid)"


def _scaling(letter: str, how: str) -> None:
    digits = 6 if how == "clipped_raw_activity" else 4  # its values have six digits already; fewer would round ties

    @query(f"t03{letter}_{how}", sql(_TEXT[how], "x", "cell_id pid", digits=digits))
    def scaled(spark, d):
        _, a, load = _projected(spark, d)
        return rounded(act.scaled_activity(a, how, load.groupBy("pid").agg(F.count(F.lit(1)).alias("genes"))), digits)


for _letter, _how in zip("abcdefghijkl", act.SCALINGS):
    _scaling(_letter, _how)


@query("t04_otsu", sql(ACT + "," + OTSU + ", r as (select * from thr)", "threshold", "pid"))
def t04(spark, d):
    return rounded(act.otsu(_activity(spark, d)))


@query("t05_high_calls", sql(ACT + "," + OTSU + ", r as (select cell_id, act.pid, x, x > threshold as high from act join thr on act.pid = thr.pid)", "x", "cell_id pid high"))
def t05(spark, d):
    a = _activity(spark, d)
    return act.high_calls(a, act.otsu(a))


@query("t06_co_expression", sql(TAIL + ", g as (select pid, count(*) as gp from load where w >= 0 group by pid), s as (select cell_id, pid, sum(t) as s from tail join load using (gene) where w >= 0 group by all), r as (select cells.cell_id, g.pid, coalesce(s, 0) / gp as x from cells cross join g left join s on s.cell_id = cells.cell_id and s.pid = g.pid)", "x", "cell_id pid"))
def t06(spark, d):
    m, y, n = customer_y(spark, d)
    return rounded(act.co_expression(y.withColumn("y", F.round("y", 6)), m.cells, n, _loadings(spark, d, m.counts)))


@query("t06_co_expression_all", sql(TAIL + ", g as (select pid, count(*) as ga from load group by pid), s as (select cell_id, pid, sum(t) as s from tail join load using (gene) group by all), r as (select cells.cell_id, g.pid, coalesce(s, 0) / ga as x from cells cross join g left join s on s.cell_id = cells.cell_id and s.pid = g.pid)", "x", "cell_id pid"))
def t06a(spark, d):
    m, y, n = customer_y(spark, d)
    return rounded(act.co_expression(y.withColumn("y", F.round("y", 6)), m.cells, n, _loadings(spark, d, m.counts), "allgenes"))


_SCALED = _CURVE.replace("r as (select cell_id, zs.pid", "zx as (select cell_id, zs.pid") + ", sc as (select cell_id, pid, round(x, 4) + 0.0 as x from zx)," + OTSU.replace("from act ", "from sc ")


@query("h08_scaled_high_calls", sql(_SCALED + ", r as (select sc.cell_id, sc.pid, act.x as raw, sc.x, sc.x > threshold as high from sc join thr on sc.pid = thr.pid join act on act.cell_id = sc.cell_id and act.pid = sc.pid)", "raw x", "cell_id pid high"))
def h08(spark, d):
    """Projection, scaling, threshold and calls in one, raw values beside the scaled ones."""
    _, raw, load = _projected(spark, d)
    sizes = load.groupBy("pid").agg(F.count(F.lit(1)).alias("genes"))
    calls, _ = act.with_calls(raw, stored(rounded(act.scaled_activity(raw, "curvature_clip", sizes), 4)))
    return rounded(calls)


@query("t01_eigen_residuals", sql(LOAD + ", r as (select pid, 0e0 as residual, 1e0 as norm, true as turned from load group by pid)", "residual norm", "pid turned"))
def t01r(spark, d):
    """How far A v is from its own multiple of v, the length of v, and whether half of its weights or more are positive."""
    m, y, n = customer_y(spark, d)
    pairs, load = stored(dep.pairs(y, n)), stored(_loadings(spark, d, m.counts).select("pid", "gene"))
    v = stored(act.eigen_loadings(pairs, load).select("pid", "gene", "w"))
    a, b = v.select("pid", F.col("gene").alias("g1"), F.col("w").alias("w1")), v.select("pid", F.col("gene").alias("g2"), F.col("w").alias("w2"))
    inside = pairs.select("g1", "g2", (F.signum("corr") * F.col("ids")).alias("m")).join(a, "g1").join(b, ["pid", "g2"])
    parts = inside.select("pid", F.col("g1").alias("gene"), (F.col("m") * F.col("w2")).alias("x")).union(inside.select("pid", "g2", F.col("m") * F.col("w1"))).union(v)
    av = parts.groupBy("pid", "gene").agg(F.sum("x").alias("av")).join(v, ["pid", "gene"])
    value = av.groupBy("pid").agg(F.sum(F.col("av") * F.col("w")).alias("l"), F.sum(F.col("w") * F.col("w")).alias("norm"), (2 * F.count_if(F.col("w") > 0) >= F.count(F.lit(1))).alias("turned"))
    return rounded(av.join(F.broadcast(value), "pid").groupBy("pid", "norm", "turned").agg(F.max(F.abs(F.col("av") - F.col("l") * F.col("w"))).alias("residual")))


@query("h09_plotted_activity", sql(ACT + ", r as (select cell_id, pid, case when pid = 1 then x else 2 * x end as x from act)", "x", "cell_id pid"))
def h09(spark, d):
    """Scaled values where there are any, else raw ones: program 1 has none."""
    raw = _activity(spark, d)
    calls = raw.select("cell_id", "pid", F.col("x").alias("raw"), F.when(F.col("pid") != 1, 2 * F.col("x")).alias("x"))
    return rounded(act.plotted(calls))


@query("e01_nearest_neighbours", sql(ACT + """, v as (select cell_id, list(x order by pid) as v from act group by cell_id),
d as (select a.cell_id as id, b.cell_id as neighbor, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), 9) as d from v a join v b on a.cell_id <> b.cell_id),
r as (select id, rank::integer as rank, neighbor, sqrt(d) as distance from (select *, row_number() over (partition by id order by d, neighbor) as rank from d) where rank <= 15)""", "distance", "id rank neighbor"))
def e01(spark, d):
    """The 15 nearest customers by programs, exact here."""
    return rounded(lay.nearest(_points(spark, d)))


@query("e02_clusters")
def e02(spark, d):
    points = _points(spark, d)
    return lay.clusters(points, lay.nearest(points))


@query("e03_plane")
def e03(spark, d):
    return rounded(lay.plane(_points(spark, d)))


#: 0 and 2 are nearest (0.05), then 1 and 3 (0.1); the two pairs join last, the older one to the left.
@query("e05_leaf_order", "select * from (values (0, 0), (1, 2), (2, 1), (3, 3)) t(place, program)")
def e05(spark, d):
    r = [[1, 0.1, 0.9, 0.2], [0.1, 1, 0.0, 0.8], [0.9, 0.0, 1, 0.1], [0.2, 0.8, 0.1, 1]]
    return spark.createDataFrame(list(enumerate(lay.leaf_order(r))), "place int, program int")


@query("w07_upper_tail", sql(TAIL + ", r as (select cell_id, gene, t from tail)", "t", "cell_id gene"))
def w07(spark, d):
    _, y, n = customer_y(spark, d)
    return rounded(act.tail_scores(y.withColumn("y", F.round("y", 6)), n).select("cell_id", "gene", "t"))


@query("w13_kth_largest", sql(ACT + ", r as (select pid, x as kth from act qualify row_number() over (partition by pid order by x desc) = 100)", "kth", "pid"))
def w13(spark, d):
    k = F.row_number().over(W.partitionBy("pid").orderBy(F.desc("x")))
    return _activity(spark, d).withColumn("k", k).where("k = 100").select("pid", F.col("x").alias("kth"))
