"""Programs from the significance graph: clique peeling, communities, growth, splitting and merging.

Peeling is parallel over seeds; cliques without subsets, and densities between them, are relations
(operators.graph). What follows works on the graph of the maximal cliques, on the driver: its size is
that of these cliques, not of the data. Graphs are dicts from a gene to the set of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

Graph = dict[str, set[str]]


def maximum_cliques(graph: Graph, within: Iterable[str]) -> list[list[str]]:
    """All largest cliques among the vertices, each sorted, in order; Bron and Kerbosch with pivots, on bit sets."""
    names = sorted(within)
    at = {v: i for i, v in enumerate(names)}
    near = [sum(1 << at[w] for w in graph.get(v, ()) if w in at and w != v) for v in names]
    best: list[int] = [0, 0]
    found: list[int] = []

    def bits(x: int) -> Iterable[int]:
        while x:
            low = x & -x
            yield low.bit_length() - 1
            x ^= low

    def grow(r: int, size: int, p: int, x: int) -> None:
        if size + p.bit_count() < best[0]:
            return
        if not p and not x:
            if size > best[0]:
                best[0] = size
                found.clear()
            found.append(r)
            return
        pivot = max(bits(p | x), key=lambda v: (p & near[v]).bit_count())
        for v in list(bits(p & ~near[pivot])):
            grow(r | 1 << v, size + 1, p & near[v], x & near[v])
            p &= ~(1 << v)
            x |= 1 << v

    if names:
        grow(0, 0, (1 << len(names)) - 1, 0)
    return sorted([names[i] for i in bits(r)] for r in found)


def peel(graph: Graph, seed: str, pool: set[str], least: int = 5) -> list[list[str]]:
    """Largest cliques that hold the seed, one after another, without the members of those before; the first by name wins."""
    left, out = pool - {seed}, []
    while True:
        near = left & graph.get(seed, set())
        cliques = maximum_cliques(graph, near) if near else []
        if not cliques or len(cliques[0]) + 1 < least:
            return out
        best = min(sorted([*c, seed]) for c in cliques)
        out.append(best)
        left -= set(best)


def seed_cliques(edges: DataFrame, hits: DataFrame, least: int = 5) -> DataFrame:
    """(seed, neighborhood_size, rank, genes): cliques peeled from each gene's hits; hits: (gene, neighbor)."""
    near = hits.selectExpr("gene as seed", "neighbor as v").union(hits.selectExpr("gene", "gene")).distinct()
    inside = near.withColumnRenamed("v", "a").join(edges, "a").join(near.withColumnRenamed("v", "b"), ["seed", "b"]).select("seed", "a", "b")

    def work(t: pd.DataFrame) -> pd.DataFrame:
        graph: Graph = {}
        for a, b in zip(t["a"], t["b"]):
            graph.setdefault(a, set()).add(b)
        seed = t["seed"].iloc[0]
        got = peel(graph, seed, set(graph), least)
        if not got:
            return pd.DataFrame()
        return pd.DataFrame({"seed": [seed] * len(got), "neighborhood_size": [len(graph)] * len(got), "rank": range(len(got)), "genes": got})

    return inside.groupBy("seed").applyInPandas(work, "seed string, neighborhood_size int, rank int, genes array<string>")


def without_bridges(n: int, weights: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """The weighted edges that lie on a cycle."""
    near: dict[int, list[int]] = {}
    for i, j in weights:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    order, low, bridges = {}, {}, set()
    for root in range(n):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(near.get(root, ())))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(near.get(w, ()))))
                    break
                if w != parent:
                    low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        bridges.add((min(v, parent), max(v, parent)))
    return {e: w for e, w in weights.items() if (min(e), max(e)) not in bridges}


def communities(n: int, weights: dict[tuple[int, int], float], resolution: float = 1.0) -> list[list[int]]:
    """Louvain's method in a fixed order of vertices; lone vertices stay alone. Lists are in order of their least member."""
    groups = [[v] for v in range(n)]
    links = {(min(e), max(e)): w for e, w in weights.items() if w > 0}
    while True:
        near: dict[int, dict[int, float]] = {v: {} for v in range(len(groups))}
        degree = [0.0] * len(groups)
        for (i, j), w in links.items():
            if i != j:
                near[i][j] = near[i].get(j, 0.0) + w
                near[j][i] = near[j].get(i, 0.0) + w
            degree[i] += w
            degree[j] += w
        total = sum(degree)
        if not total:
            break
        own = list(range(len(groups)))
        mass = degree[:]
        moved, any_move = True, False
        while moved:
            moved = False
            for v in range(len(groups)):
                to: dict[int, float] = {}
                for u, w in near[v].items():
                    to[own[u]] = to.get(own[u], 0.0) + w
                mass[own[v]] -= degree[v]
                gain = lambda c: to.get(c, 0.0) - resolution * degree[v] * mass[c] / total  # noqa: B023, E731
                best = max([own[v], *sorted(to)], key=lambda c: (round(gain(c), 12), c == own[v], -c))
                mass[best] += degree[v]
                if best != own[v]:
                    own[v], moved, any_move = best, True, True
        if not any_move:
            break
        names = {c: k for k, c in enumerate(dict.fromkeys(own))}
        merged: list[list[int]] = [[] for _ in names]
        for v, c in enumerate(own):
            merged[names[c]] += groups[v]
        folded: dict[tuple[int, int], float] = {}
        for (i, j), w in links.items():
            e = tuple(sorted((names[own[i]], names[own[j]])))
            folded[e] = folded.get(e, 0.0) + w
        groups, links = merged, folded
    return sorted((sorted(g) for g in groups), key=lambda g: g[0])


def edges_between(graph: Graph, a: Iterable[str], b: Iterable[str]) -> int:
    b = set(b)
    return sum(len(graph.get(x, set()) & b) for x in a)


def density_of(graph: Graph, a: Iterable[str], b: Iterable[str]) -> float:
    a, b = set(a), set(b)
    return edges_between(graph, a, b) / (len(a) * len(b)) if a and b else 0.0


def inner_density(graph: Graph, genes: Iterable[str]) -> float:
    g = set(genes)
    return edges_between(graph, g, g) / (len(g) * (len(g) - 1)) if len(g) > 1 else float("nan")


def connectivity(graph: Graph, gene: str, group: set[str]) -> float:
    return len(graph.get(gene, set()) & group) / len(group) if group else 0.0


def weights_of(graph: Graph, groups: list[list[str]]) -> dict[tuple[int, int], float]:
    return {(i, j): d for j in range(len(groups)) for i in range(j) if (d := density_of(graph, groups[i], groups[j])) > 0}


def extract(graph: Graph, pool: set[str], least: int = 5) -> dict:
    """A community's core, its cliques with their densities and peripheries, and the penumbra that is left."""
    largest = lambda s: max(maximum_cliques(graph, s), default=[])  # noqa: E731  the last by name
    core = largest(pool)
    left, cliques, take = set(pool) - set(core), [core], []
    while len(take := largest(left)) >= least:
        cliques.append(take)
        left -= set(take)
    around = lambda c: sorted(g for g in left if connectivity(graph, g, set(c)) >= 0.5)
    return {"core": core, "cliques": [{"genes": c, "size": len(c), "density": inner_density(graph, c), "periphery": around(c)} for c in cliques if c], "penumbra": sorted(left)}


#: The density that genes added in the first round of growth keep among themselves, whatever the setting of growth.
ADDED_DENSITY = 0.9


def grow(graph: Graph, clique: list[str], penumbra: list[str], near: float = 0.9) -> list[str]:
    """The clique with genes of its community's penumbra that are connected to more than `near` of it.

    First the best connected, as long as those added are dense among themselves; then all that are
    connected to what has come out of that.
    """
    base, added = set(clique), []
    wanted = sorted((g for g in penumbra if g not in base and connectivity(graph, g, base) > near), key=lambda g: -connectivity(graph, g, base))
    for g in wanted:
        if added and inner_density(graph, [*added, g]) < ADDED_DENSITY:
            break
        added.append(g)
    whole = base | set(added)
    return sorted(whole | {g for g in penumbra if g not in whole and connectivity(graph, g, whole) > near})


def prune(graph: Graph, groups: list[list[str]], cluster: list[int], least: float = 0.5) -> list[list[int]]:
    """The cluster, without members taken out one by one until the union is dense; these stand alone."""
    left, out = list(cluster), []
    while len(left) > 1 and inner_density(graph, set().union(*(groups[i] for i in left))) < least:
        mean = {i: sum(density_of(graph, groups[i], groups[j]) for j in left if j != i) / (len(left) - 1) for i in left}
        worst = min(left, key=lambda i: (mean[i], i))
        left.remove(worst)
        out.append([worst])
    return [left, *out]


def cover(graph: Graph, genes: Iterable[str]) -> list[list[str]]:
    """Largest cliques, one after another without the members of those before, until no gene is left; the first by name wins."""
    left, out = set(genes), []
    while left:
        out.append(maximum_cliques(graph, left)[0])
        left -= set(out[-1])
    return out


def split(graph: Graph, program: tuple[list[str], set[str]], least: int = 5, connected: float = 0.5) -> list[tuple[list[str], set[str]]]:
    """What is left, if anything, and then the cliques that are badly connected to all other genes of the program; all keep the periphery."""
    genes, periphery = program
    cliques = cover(graph, genes) if len(genes) >= least else []
    if len(cliques) < 2:
        return [program]
    off = [c for c in cliques if len(c) > least and density_of(graph, c, set(genes) - set(c)) < connected]
    kept = sorted(g for c in cliques if c not in off for g in c)
    return [(kept, periphery)] * bool(kept) + [(c, periphery) for c in off]


def heat_order(graph: Graph, programs: list[list[str]]) -> list[tuple[int, str]]:
    """(program, gene) in the order of a block-diagonal picture: each program's genes by its cover."""
    return [(k, g) for k, p in enumerate(programs) for c in cover(graph, [g for g in p if g in graph]) for g in c]


def ordered(programs: list[tuple[list[str], set[str]]]) -> list[tuple[list[str], set[str]]]:
    return sorted(programs, key=lambda p: (-len(p[0]), p[0]))


def _union(a: tuple[list[str], set[str]], b: tuple[list[str], set[str]]) -> tuple[list[str], set[str]]:
    return sorted({*a[0], *b[0]}), a[1] | b[1]


def merge_dense(graph: Graph, programs: list[tuple[list[str], set[str]]], more_than: float = 0.8) -> list[tuple[list[str], set[str]]]:
    """Merge the densest pair, the first if tied, while it is above the limit; what is merged goes last."""
    programs = list(programs)
    while True:
        pairs = [(density_of(graph, programs[i][0], programs[j][0]), -i, -j) for i in range(len(programs)) for j in range(i + 1, len(programs))]
        if not pairs or max(pairs)[0] <= more_than:
            return ordered(programs)
        _, i, j = max(pairs)
        new = _union(programs[-i], programs[-j])
        programs = [p for k, p in enumerate(programs) if k not in (-i, -j)] + [new]


def merge_contained(programs: list[tuple[list[str], set[str]]], more_than: float = 0.7) -> list[tuple[list[str], set[str]]]:
    """Merge the pair that shares the greatest part of its smaller one, the first if tied, in place of its first, while that part is above the limit."""
    programs = list(programs)
    while True:
        best, pair = more_than, None
        for i, (a, _) in enumerate(programs):
            for j in range(i + 1, len(programs)):
                b = programs[j][0]
                part = len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0
                if part > best:
                    best, pair = part, (i, j)
        if pair is None:
            return ordered(programs)
        i, j = pair
        programs[i] = _union(programs[i], programs[j])
        del programs[j]


def stage_two(graph: Graph, groups: list[list[str]], weights: dict[tuple[int, int], float], least: int = 5, resolution: float = 1.0) -> list[dict]:
    """Bridge-free communities of cliques with their cores, cliques and penumbras, the largest union first."""
    out = []
    for k, c in enumerate(communities(len(groups), without_bridges(len(groups), weights), resolution)):
        pool = set().union(*(groups[i] for i in c))
        if len(pool) > 1:
            out.append({"community": k, **extract(graph, pool, least), "total_size": len(pool), "full_density": inner_density(graph, pool), "num_input_cliques": len(c)})
    return sorted(out, key=lambda s: -s["total_size"])


def stage_three(graph: Graph, stage2: list[dict], least: int = 5, near: float = 0.9, containment: float = 0.7) -> list[tuple[list[str], set[str]]]:
    """Programs and their peripheries: grown, clustered and pruned, split, merged."""
    grown = [(grow(graph, c["genes"], s["penumbra"], near), set(c["periphery"])) for s in stage2 for c in s["cliques"]]
    grown = ordered(grown)
    groups = [g for g, _ in grown]
    parts = [p for c in communities(len(groups), weights_of(graph, groups), 2.0) for p in prune(graph, groups, c)]
    programs = ordered([(sorted(set().union(*(groups[i] for i in p))), set().union(*(grown[i][1] for i in p))) for p in parts])
    programs = ordered([q for p in programs for q in split(graph, p, least)])
    return merge_contained(merge_dense(graph, programs), containment)


def find_programs(graph: Graph, cliques: list[list[str]], least: int = 5, near: float = 0.9, resolution: float = 1.0, containment: float = 0.7, weights: dict[tuple[int, int], float] | None = None) -> list[dict]:
    """Programs and their peripheries from all peeled cliques; weights: densities between them, if these are maximal and in order already."""
    groups = cliques
    if weights is None:
        sets = sorted({tuple(c) for c in cliques}, key=lambda c: (-len(c), c))
        groups = [list(c) for c in sets if not any(len(d) > len(c) and set(c) < set(d) for d in sets)]
        weights = weights_of(graph, groups)
    if not groups:
        return []
    programs = stage_three(graph, stage_two(graph, groups, weights, least, resolution), least, near, containment)
    return [{"program": g, "periphery": sorted(around - set(g))} for g, around in programs if len(g) >= least]


def evaluate(graph: Graph, programs: list[dict]) -> dict:
    """The figures by which programs are judged."""
    genes = [p["program"] for p in programs]
    slots, unique = sum(map(len, genes)), len(set().union(*genes)) if genes else 0
    jaccard, pair = 0.0, [-1, -1]
    for i, a in enumerate(genes):
        for j in range(i + 1, len(genes)):
            part = len(set(a) & set(genes[j])) / len(set(a) | set(genes[j]))
            if part > jaccard:
                jaccard, pair = part, [i, j]
    dense = [inner_density(graph, g) for g in genes if len(g) > 1]
    return {"program_count": len(genes), "slots": slots, "unique_genes": unique, "overlap_ratio": round(slots / unique, 3) if unique else 0.0, "max_jaccard": round(jaccard, 4), "max_jaccard_pair": pair, "median_density": median(dense) if dense else float("nan"), "gene_coverage": round(unique / len(graph), 4) if graph else 0.0, "program_sizes": sorted(map(len, genes), reverse=True)}
