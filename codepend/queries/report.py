"""Records, annotation and report data."""

from pyspark.sql import functions as F

from ..operators import annotate as an
from ..operators.ranks import percentiles
from ..registry import query
from ..sources.tables import stored
from .activity import ACT, LOAD, _activity, _loadings, _projected
from .common import PAIRS, customer_pairs, rounded, sql
from .graph import BASE, _groups
from ..operators import activity as act

REPLY = "'Title: ' || p_type || chr(10) || 'Inconsistent Genes: ' || case when p_partkey % 3 = 0 then 'None' else p_brand || ', other ,' end || chr(10) || case when p_partkey % 2 = 0 then 'Summary: size ' else 'size ' end || p_size"


def _replies(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    bad = F.when(F.col("p_partkey") % 3 == 0, "None").otherwise(F.concat("p_brand", F.lit(", other ,")))
    end = F.when(F.col("p_partkey") % 2 == 0, "Summary: size ").otherwise("size ")
    return p.select("p_partkey", "p_brand", F.concat(F.lit("Title: "), "p_type", F.lit("\nInconsistent Genes: "), bad, F.lit("\n"), end, F.col("p_size").cast("string")).alias("reply"))


def _programs(spark, d):
    g = _groups(spark, d)
    return g.select(F.col("gid").alias("pid"), F.col("genes").alias("program"), F.array(F.lit("Brand#1"), F.lit("Brand#99")).alias("periphery"))


@query("a11_a12_programs_json", sql(BASE + ", r as (select gid as pid, unnest(range(len(genes)))::integer as place, unnest(genes) as gene from grp)", "", "pid place gene", ""))
def a11(spark, d):
    """Programs written as JSON and read back."""
    return an.program_genes(an.program_json(_programs(spark, d)))


@query("a12_program_json", sql(BASE + """, r as (select gid as pid, '{"program":["' || array_to_string(genes, '","') || '"],"periphery":["' || case when list_contains(genes, 'Brand#1') then '' else 'Brand#1","' end || 'Brand#99"]}' as json from grp)""", "", "pid json", ""))
def a12(spark, d):
    return an.program_json(_programs(spark, d))


@query("a13_loadings_json", sql(LOAD + """, r as (select pid, '{' || string_agg('"' || gene || '":' || w, ',' order by gene) || '}' as json from load group by pid)""", "", "pid json"))
def a13(spark, d):
    return an.loadings_json(_loadings(spark, d))


@query("e04_program_correlation", sql(ACT + ", r as (select x.pid as i, y.pid as j, corr(x.x, y.x) as r from act x join act y on x.cell_id = y.cell_id and x.pid < y.pid group by all)", "r", "i j"))
def e04(spark, d):
    a = _activity(spark, d)
    x, y = a.select("cell_id", F.col("pid").alias("i"), F.col("x").alias("u")), a.select("cell_id", F.col("pid").alias("j"), F.col("x").alias("v"))
    return rounded(x.join(y, "cell_id").where("i < j").groupBy("i", "j").agg(F.corr("u", "v").alias("r")))


@query("e06_centroids_medoids", sql(ACT + """, v as (select cells.cell_id, cell_type, sum(x) filter (pid = 0) as a, sum(x) filter (pid = 1) as b from act join cells using (cell_id) group by all),
c as (select cell_type, median(a) as ca, median(b) as cb from v group by 1), r as (select cell_type, ca, cb, cell_id as medoid from v join c using (cell_type) qualify row_number() over (partition by cell_type order by round((a - ca) ** 2 + (b - cb) ** 2, 9), cell_id) = 1)""", "ca cb", "cell_type medoid"))
def e06(spark, d):
    m, a, _ = _projected(spark, d)
    at = lambda k: F.sum(F.when(F.col("pid") == k, F.col("x")))
    v = stored(a.join(m.cells, "cell_id").groupBy("cell_id", "cell_type").agg(at(0).alias("a"), at(1).alias("b")))
    of = lambda x, name: percentiles(v, x, (0.5,), ["cell_type"]).select("cell_type", F.col("q")[0].alias(name))
    c = of("a", "ca").join(of("b", "cb"), "cell_type")
    far = F.round(F.pow(F.col("a") - F.col("ca"), 2) + F.pow(F.col("b") - F.col("cb"), 2), 9)
    near = v.join(F.broadcast(c), "cell_type").groupBy("cell_type", "ca", "cb").agg(F.min(F.struct(far.alias("f"), "cell_id"))["cell_id"].alias("medoid"))
    return rounded(near)


@query("e07_quartiles_by_type", sql(ACT + ", r as (select cell_type, pid, quantile_cont(x, 25e-2) as q1, median(x) as med, quantile_cont(x, 75e-2) as q3 from act join cells using (cell_id) group by all)", "q1 med q3", "cell_type pid"))
def e07(spark, d):
    m, a, _ = _projected(spark, d)
    v = percentiles(a.join(m.cells, "cell_id"), "x", (0.25, 0.5, 0.75), ["cell_type", "pid"])
    return rounded(v.select("cell_type", "pid", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3")))


@query("e08_s04_type_counts", "select c_mktsegment as cell_type, count(*) as n, case when count(*) <= 30 then 'gray' else 'own' end as colour from customer group by 1")
def e08(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("cell_type")).agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("colour", F.when(F.col("n") <= 30, "gray").otherwise("own")).orderBy(F.desc("n"), "cell_type")


@query("e09_colour_bounds", sql(ACT + ", r as (select pid, min(x) as lo, max(x) as hi, case when min(x) < 0 and max(x) > 0 then 'diverging' else 'sequential' end as kind from act group by pid)", "lo hi", "pid kind"))
def e09(spark, d):
    b = _activity(spark, d).groupBy("pid").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return b.withColumn("kind", F.when((F.col("lo") < 0) & (F.col("hi") > 0), "diverging").otherwise("sequential"))


@query("e10_empty_summaries", sql(BASE + """, r as (select 'Program ' || gid as "Program", '' as "Title", array_to_string(genes, ', ') as "Genes", len(genes)::integer as "Number of Genes", '' as "Inconsistent Genes", 0 as "Number of Inconsistent Genes", '' as "Summary" from grp)""", "", "*", ""))
def e10(spark, d):
    return an.empty_summaries(_programs(spark, d))


@query("e12_g19_j10_overview", sql(BASE + ", s as (select p_size || ' ' || p_type as pid, min(p_name) as title, min(p_size) as b from part where p_size % 2 = 0 group by 1), rows_ as (select gid as pid, coalesce(title, '') as title, len(genes) as n_genes, coalesce(b, 0)::bigint as n_inconsistent from grp left join s on gid = s.pid), r as (select * from rows_ union all select 'total', '', sum(n_genes)::bigint, sum(n_inconsistent)::bigint from rows_)", "", "pid title n_genes n_inconsistent", ""))
def e12(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size % 2 = 0").groupBy(F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_type").alias("pid")).agg(F.min("p_name").alias("title"), F.min("p_size").alias("n_bad"))
    return an.overview(_programs(spark, d), p)


@query("f08_signed_ids", sql(PAIRS + ", r as (select g1, g2, sign(round(corr, 6)) * ids as v from pairs)", "v", "g1 g2"))
def f08(spark, d):
    return rounded(customer_pairs(spark, d).select("g1", "g2", (F.signum(F.round("corr", 6)) * F.col("ids")).alias("v")))


@query("f11_f12_reply_parts", f"with t as (select p_partkey, p_brand, {REPLY} as reply from part), x as (select *, trim(regexp_extract(reply, '(?m)^Title:[ \\t]*(.*)$', 1)) as title, trim(regexp_extract(reply, '(?m)^Inconsistent Genes:[ \\t]*(.*)$', 1)) as inconsistent, trim(case when instr(reply, 'Summary:') > 0 then substr(reply, instr(reply, 'Summary:') + 8) else reply end) as summary from t) select p_partkey, title, inconsistent, summary, case when upper(inconsistent) = 'NONE' then '' else p_brand end as own from x")
def f11(spark, d):
    r = _replies(spark, d)
    r = r.withColumns(an.reply_parts(F.col("reply")))
    return r.select("p_partkey", "title", "inconsistent", "summary", F.array_join(an.own_genes(F.col("inconsistent"), F.array("p_brand")), ",").alias("own"))


@query("f13_prompts", sql(LOAD + ", r as (select pid, 'Positive genes: ' || coalesce(string_agg(gene, ', ' order by gene) filter (w > 0), '') || chr(10) || 'Negative genes: ' || coalesce(string_agg(gene, ', ' order by gene) filter (w < 0), '') as prompt from load group by pid)", "", "pid prompt"))
def f13(spark, d):
    maps = _loadings(spark, d).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("gene", "w"))).alias("w"))
    return maps.select("pid", an.prompt(F.col("w")).alias("prompt"))


@query("f16_loading_access", sql(LOAD + ", r as (select pid, coalesce(max(w) filter (gene = 'Brand#9'), 1e0) as w from load group by pid)", "w", "pid"))
def f16(spark, d):
    maps = _loadings(spark, d).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("gene", "w"))).alias("m"))
    return rounded(maps.select("pid", F.coalesce(F.try_element_at("m", F.lit("Brand#9")), F.lit(1.0)).alias("w")))
