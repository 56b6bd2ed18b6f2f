"""The graph and its programs (B24, C01-C14, G14, G15, J04-J08, J11, S01-S08, S11). Groups are the brands of each part size and type, those of one type twice; many of them nest."""

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import programs as pr
from ..operators.graph import clique_graph
from ..registry import query
from .common import rounded, sql

BASE = """grp as (select p_size || ' ' || p_type as gid, list_sort(list(distinct p_brand)) as genes from part group by 1 union all select 'also ' || p_size, list_sort(list(distinct p_brand)) from part where p_type = 'SMALL' group by 1), mem as (select gid, unnest(genes) as gene from grp), br as (select distinct p_brand as g, substr(p_brand, 7)::integer as nr from part),
e as (select x.g as a, y.g as b from br x, br y where x.g <> y.g and (x.nr + y.nr) % 3 <> 0)"""
DG = BASE + ", dg as (select min(gid) as gid, genes from grp group by genes)"
SH = BASE + ", sh as (select x.gid as i, y.gid as j, count(*) as n from mem x join mem y on x.gene = y.gene and x.gid < y.gid group by all), sz as (select gid, len(genes) as s from grp)"
INNER = BASE + ", inn as (select grp.gid, case when len(genes) >= 2 then (select count(*) from e where list_contains(genes, a) and list_contains(genes, b) and a < b) / (len(genes) * (len(genes) - 1) / 2) end as density from grp)"


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def _groups(spark, d):
    p, size = _part(spark, d), F.col("p_size").cast("string")
    of = lambda df, gid: df.groupBy(gid.alias("gid")).agg(F.array_sort(F.collect_set("p_brand")).alias("genes"))
    return of(p, F.concat(size, F.lit(" "), "p_type")).union(of(p.where("p_type = 'SMALL'"), F.concat(F.lit("also "), size)))


def _edges(spark, d):
    """Brands whose numbers' sum isn't a multiple of 3, by their remainders."""
    b = _part(spark, d).select(F.col("p_brand").alias("a")).distinct().withColumn("k", F.expr("int(substring(a, 7)) % 3"))
    want = b.withColumn("r", F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda r: (F.col("k") + r) % 3 != 0))).select("a", "r")
    return want.join(b.select(F.col("a").alias("b"), F.col("k").alias("r")), "r").where("a <> b").select("a", "b")


def _named(df):
    return df.select("gid", F.array_join("genes", ",").alias("genes"))


@query("b24_min_program_size", sql(BASE + ", r as (select gid, array_to_string(genes, ',') as genes from grp where len(genes) >= 5)", "", "gid genes", ""))
def b24(spark, d):
    return _named(_groups(spark, d).where(F.size("genes") >= 5))


@query("c01_seed_cliques")
def c01(spark, d):
    """Cliques peeled from every brand's neighbourhood, in parallel by seed."""
    e = _edges(spark, d)
    return pr.seed_cliques(e, e.selectExpr("a as gene", "b as neighbor"), 3)


@query("c02_maximal_groups", sql(DG + ", r as (select gid, array_to_string(genes, ',') as genes from dg where not exists (select 1 from dg y where len(y.genes) > len(dg.genes) and list_has_all(y.genes, dg.genes)))", "", "gid genes", ""))
def c02(spark, d):
    return _named(gr.maximal_groups(_groups(spark, d)))


@query("c03_group_densities", sql(BASE + ", r as (select x.gid as i, y.gid as j, count(*) / (any_value(len(gx.genes)) * any_value(len(gy.genes))) as density from mem x join e on x.gene = a join mem y on y.gene = b and x.gid < y.gid join grp gx on gx.gid = x.gid join grp gy on gy.gid = y.gid group by all)", "density", "i j", ""))
def c03(spark, d):
    return rounded(gr.densities(_groups(spark, d), _edges(spark, d)))


def _graph(spark, d):
    """The brand graph as a dict; it has as many vertices as there are brands."""
    out = {}
    for r in _edges(spark, d).toLocalIterator():
        out.setdefault(r["a"], set()).add(r["b"])
    return out


def _toy(*groups: str, drop: str = "") -> pr.Graph:
    """Cliques of one-letter genes, without the edges named in pairs of letters."""
    out: pr.Graph = {}
    gone = {frozenset(x) for x in drop.split()}
    for g in groups:
        for a in g:
            out.setdefault(a, set()).update(b for b in g if b != a and frozenset((a, b)) not in gone)
    return out


def _fixed(*rows: str) -> str:
    """SQL of worked-out rows (place, genes)."""
    return "select place::integer as place, genes from (values " + ", ".join(f"({k}, '{g}')" for k, g in enumerate(rows)) + ") t(place, genes)"


def _placed(spark, lists):
    return spark.createDataFrame([(k, "".join(g)) for k, g in enumerate(lists)], "place int, genes string")


#: Worked by hand: f, g and z are next to all of a-e. z is no gene of the penumbra; f and g aren't adjacent, so g isn't added after f, and in the second round g has 5 of 6.
@query("c07_growth", _fixed("abcdef", "abcde", "abcdefg"))
def c07(spark, d):
    """Two rounds of growth, without a penumbra, and where f and g are adjacent, on toy graphs."""
    apart, close = _toy("abcdefz", "abcdegz", drop="fg"), _toy("abcdefgz")
    return _placed(spark, [pr.grow(apart, list("abcde"), list("fg")), pr.grow(apart, list("abcde"), []), pr.grow(close, list("abcde"), list("fg"))])


@query("c04_bridges", "select * from (values (0, 1), (0, 2), (1, 2)) t(i, j)")
def c04(spark, d):
    """Edges that lie on a cycle: a triangle keeps its own, a path hanging from it goes."""
    w = pr.without_bridges(5, {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 1.0, (2, 3): 1.0, (3, 4): 1.0})
    return spark.createDataFrame(sorted(w), "i int, j int")


#: abcdef and uvwxyz (no edge between them) and mn (next to each other, to a and to u): both sixes have less than half of the edges to the rest, so both go and mn is left.
@query("c10_split", _fixed("mn", "abcdef", "uvwxyz", "abcdef", "abcdefuvwxyz"))
def c10(spark, d):
    """A program of two badly connected cliques and a rest; one clique alone; cliques of which none is badly connected."""
    g = _toy("abcdef", "uvwxyz", "mn", "am", "un")
    full = _toy("abcdefuvwx", "uvwxyz", "abcdefyz")
    parts = [pr.split(g, (sorted("abcdefuvwxyzmn"), set())), pr.split(g, (list("abcdef"), set())), pr.split(full, (sorted("abcdefuvwxyz"), set()))]
    return _placed(spark, [p for x in parts for p, _ in x])


#: abcde and abcdf share 4 of 5; abcdefgh and bcdefgi 6 of 7, the greatest part, so these merge first and take both of the others up.
@query("c12_containment_merge", _fixed("abcdefghi", "uvwxyz", "vwxyk"))
def c12m(spark, d):
    """The pair of greatest overlap merges first, in place of its first; the limit itself doesn't merge (7 of 10)."""
    p = [(list(x), set()) for x in ("abcde", "abcdf", "abcdefgh", "bcdefgi")]
    near = [(list(x), set()) for x in ("uvwxyz", "vwxyk")]
    return _placed(spark, [g for g, _ in [*pr.merge_contained(p), *pr.merge_contained(near, 0.8)]])


#: Both fives are fully joined but for 2 of 25 edges (0.92 > 0.8); klmno has no edge to them.
@query("c11_density_merge", _fixed("abcdefghij", "klmno"))
def c11(spark, d):
    g = _toy("abcdefghij", "klmno", drop="af bg")
    return _placed(spark, [x for x, _ in pr.merge_dense(g, [(list("abcde"), set()), (list("fghij"), set()), (list("klmno"), set())])])


#: The union of all three has 15 of its 36 edges, less than half; klmn has none to the others and goes; then 9 of 10 are there.
@query("c08_pruned_clusters", "select * from (values (0, '1,2'), (1, '0')) t(place, members)")
def c08(spark, d):
    """klmn leaves the cluster of abcd and bcde, with which it shares nothing."""
    g = _toy("klmn", "abcd", "bcde")
    groups = [list("klmn"), list("abcd"), list("bcde")]
    return spark.createDataFrame([(k, ",".join(map(str, sorted(p)))) for k, p in enumerate(pr.prune(g, groups, [0, 1, 2]))], "place int, members string")


@query("c09_c14_heat_order", _fixed("0a", "0b", "0c", "0d", "0x", "0y", "0z", "1k", "1l"))
def c14(spark, d):
    """Genes in the order of a block-diagonal picture: largest cliques first, ties by name."""
    g = _toy("abcd", "xyz", "ax", "kl")
    return _placed(spark, [f"{k}{x}" for k, x in pr.heat_order(g, [list("xyzabcd"), list("lk")])])


@query("c05_communities", "select * from (values (0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 8)) t(community, member)")
def c05(spark, d):
    """Two groups of four joined by one weak edge, which is a bridge and goes, and a vertex alone."""
    two = {(i, j): 1.0 for base in (0, 4) for i in range(base, base + 4) for j in range(i + 1, base + 4)} | {(3, 4): 0.1}
    got = pr.communities(9, pr.without_bridges(9, two))
    return spark.createDataFrame([(k, v) for k, c in enumerate(got) for v in c], "community int, member int")


#: The largest cliques are abcde and cdefg: the last by name is the core, ab are too few for a clique; both are next to three of five.
@query("c06_core_extraction", "select * from (values (0, 'cdefg', 1e0, 'ab', 'ab')) t(place, genes, density, periphery, penumbra)")
def c06(spark, d):
    g = _toy("abcde", "cdefg")
    got = pr.extract(g, set(g), 5)
    return spark.createDataFrame([(k, "".join(c["genes"]), c["density"], "".join(c["periphery"]), "".join(got["penumbra"])) for k, c in enumerate(got["cliques"])], "place int, genes string, density double, periphery string, penumbra string")


#: Two communities of unequal size: the larger union comes first, though its least clique comes last.
@query("s02_stage_two_order", "select * from (values (0, 'klmnopq', 7), (1, 'abcde', 5)) t(place, core, total_size)")
def s02(spark, d):
    g = _toy("abcde", "klmnopq")
    groups = [list("abcde"), list("klmnopq")]
    got = pr.stage_two(g, groups, pr.weights_of(g, groups))
    return spark.createDataFrame([(k, "".join(s["core"]), s["total_size"]) for k, s in enumerate(got)], "place int, core string, total_size int")


@query("step6_programs", _fixed("abcdefg", "hijklm"))
def step6(spark, d):
    """Seeds, communities, growth, splits and merges in one, on two cliques joined by an edge; cliques are relations up to the driver's part."""
    g = _toy("abcdefg", "hijklm", "gh")
    e = spark.createDataFrame(sorted((a, b) for a in g for b in g[a]), "a string, b string")
    seeds = pr.seed_cliques(e, e.selectExpr("a as gene", "b as neighbor"), 5)
    groups, weights = clique_graph(seeds, e)
    return _placed(spark, [p["program"] for p in pr.find_programs(g, groups, 5, weights=weights)])


@query("c12_containment_pairs", sql(SH + ", r as (select i, j, n / least(x.s, y.s) as ratio from sh join sz x on i = x.gid join sz y on j = y.gid where n / least(x.s, y.s) > 7e-1)", "ratio", "i j", ""))
def c12(spark, d):
    return rounded(gr.containments(_groups(spark, d)))


@query("g14_internal_density", sql(INNER + ", r as (select * from inn)", "density", "gid", ""))
def g14(spark, d):
    return rounded(gr.internal_density(_groups(spark, d), _edges(spark, d)))


@query("g15_program_metrics", sql(INNER + """, sh as (select x.gid as i, y.gid as j, count(*)::double / (any_value(len(gx.genes)) + any_value(len(gy.genes)) - count(*)) as jac from mem x join mem y on x.gene = y.gene and x.gid < y.gid join grp gx on gx.gid = x.gid join grp gy on gy.gid = y.gid group by x.gid, y.gid),
top as (select * from sh order by round(jac, 9) desc, i, j limit 1),
r as (select (select count(*) from grp) as program_count, (select count(*) from mem) as slots, (select count(distinct gene) from mem) as unique_genes, round((select jac from top), 4) as max_jaccard, (select i from top) as max_i, (select j from top) as max_j, (select median(density) from inn) as median_density,
  round((select count(*) / count(distinct gene) from mem), 3) as overlap_ratio, round((select count(distinct gene) from mem) / (select count(distinct a) from e), 4) as gene_coverage, (select array_to_string(list_sort(list(len(genes)), 'DESC'), ',') from grp) as program_sizes)""", "max_jaccard median_density overlap_ratio gene_coverage", "program_count slots unique_genes max_i max_j program_sizes", ""))
def g15(spark, d):
    m = gr.metrics(_groups(spark, d), _edges(spark, d))
    return rounded(m.withColumn("program_sizes", F.array_join(F.col("program_sizes").cast("array<string>"), ",")))


@query("j05_subsumed_groups", sql(DG + ", r as (select gid from dg where exists (select 1 from dg y where len(y.genes) > len(dg.genes) and list_has_all(y.genes, dg.genes)))", "", "gid", ""))
def j05(spark, d):
    g = _groups(spark, d)
    return gr.distinct_groups(g).join(gr.maximal_groups(g), "gid", "left_anti").select("gid")


@query("j06_induced_edges", sql(BASE + ", r as (select x.gid, a, b from mem x join e on x.gene = a join mem y on y.gid = x.gid and y.gene = b)", "", "gid a b", ""))
def j06(spark, d):
    m = gr.members(_groups(spark, d))
    return m.withColumnRenamed("gene", "a").join(_edges(spark, d), "a").join(m.withColumnRenamed("gene", "b"), ["gid", "b"]).select("gid", "a", "b")


@query("j07_shared_genes", sql(SH + ", r as (select * from sh)", "", "i j n", ""))
def j07(spark, d):
    return gr.shared_genes(_groups(spark, d))


@query("j08_peripheries", sql(BASE + ", r as (select gid, b as gene from mem join e on gene = a join grp using (gid) where not list_contains(genes, b) group by gid, b having count(*) >= 5e-1 * any_value(len(genes)))", "", "gid gene", ""))
def j08(spark, d):
    return gr.peripheries(_groups(spark, d), _edges(spark, d))


@query("j11_left_over_genes", sql(BASE + ", r as (select grp.gid, br.g as gene from grp, br where not list_contains(genes, br.g))", "", "gid gene", ""))
def j11(spark, d):
    """Brands of no part of the type: all brands less the group's."""
    g = _groups(spark, d)
    every = _part(spark, d).agg(F.collect_set("p_brand").alias("every"))
    return g.join(F.broadcast(every)).select("gid", F.explode(F.array_except("every", "genes")).alias("gene"))


@query("s01_programs_by_size", sql(BASE + ", r as (select gid, array_to_string(genes, ',') as genes, (row_number() over (order by -len(genes), genes, gid))::integer as place from grp)", "", "gid genes place", ""))
def s01(spark, d):
    from pyspark.sql import Window as W

    g = _groups(spark, d).withColumn("place", F.row_number().over(W.orderBy(-F.size("genes"), "genes", "gid")))  # a row for each program
    return g.select("gid", F.array_join("genes", ",").alias("genes"), "place")


@query("s03_first_genes", sql(BASE + ", r as (select gid, array_to_string(genes[1:3], ', ') || case when len(genes) > 3 then ' … and ' || (len(genes) - 3) || ' more' else '' end as shown from grp)", "", "gid shown", ""))
def s03(spark, d):
    from ..operators.annotate import first_genes

    return _groups(spark, d).select("gid", first_genes(F.col("genes"), 3).alias("shown"))


@query("s05_union_of_groups", sql(BASE + ", r as (select split_part(gid, ' ', 1) as head, array_to_string(list_sort(list(distinct gene)), ',') as genes from mem group by 1)", "", "head genes", ""))
def s05(spark, d):
    g = _groups(spark, d).groupBy(F.split_part("gid", F.lit(" "), F.lit(1)).alias("head")).agg(F.collect_list("genes").alias("x"))
    return g.select("head", F.array_join(F.array_sort(F.array_distinct(F.flatten("x"))), ",").alias("genes"))


@query("s08_distinct_groups", sql(DG + ", r as (select gid, array_to_string(genes, ',') as genes from dg)", "", "gid genes", ""))
def s08(spark, d):
    return _named(gr.distinct_groups(_groups(spark, d)))


@query("s11_largest_sizes", sql(BASE + ", r as (select len(genes)::integer as size, (row_number() over (order by len(genes) desc, gid))::integer as place from grp qualify place <= 10)", "", "size place", ""))
def s11(spark, d):
    """The ten greatest sizes, a report."""
    from pyspark.sql import Window as W

    w = F.row_number().over(W.orderBy(F.desc("size"), "gid"))
    return _groups(spark, d).select("gid", F.size("genes").alias("size")).orderBy(F.desc("size"), "gid").limit(10).select("size", w.alias("place"))
