"""Mixing sources to target weights, by DataFrame functions alone.

The labelled table sets the domains: its classes of (quality, toxic). A classifier over discretised
properties of a document (source bucket, language, length, digits, punctuation, word length, lines)
gives each document a posterior over domains: naive Bayes with add-one smoothing over each property's
values, its counts taken from all labelled documents. Documents that share all properties share a posterior, so they are
summed into cells before anything else; the cells are as many as combinations of properties, not
documents.

Rates then are fitted by projected gradient least squares. With T_k the expected tokens of domain k, b its
target and M the inverse of the domains' Gram matrix sum_c n_c p_c p_c', (T - b) M (T - b) / 2 falls along
r_c -> max(min_rate, r_c - p_c M (T - b)), a step that M makes of unit length; steps are accelerated, and
begin anew where the sum would rise. The rate of a cell follows from the steps so far and its posterior,
so a step needs one aggregate over cells of K sums, and nothing is kept by cell. It ends when residuals are
below TOLERANCE of b.

Where GRADIENT_STEPS don't suffice (targets that few documents can meet), the rates nearest to 1 (by tokens)
that meet the targets are found by their multipliers instead: r_c = max(min_rate, 1 + m . p_c), m by damped
Newton steps of K + K (K + 1) / 2 sums each. A slack of EPSILON keeps them finite where no rates meet the
targets: then |(T - b) / b| is least, and what is missed is logged as a warning; `fit_rates` returns the totals
before and after and the residuals.

A growing total is not set beforehand: near the least one that allows the targets, only the few cells on their
edge would be repeated, hundreds of times. Of all rates that meet T_k = w_k sum(T), whatever the sum, those nearest
to 1 are taken, by tokens and by documents alike: each cell weighs the mean of its tokens and its documents' mean
share of all tokens, l_c is its tokens over that, and r_c = max(min_rate, 1 + l_c m . (p_c - w)), m by the same
Newton steps. The slack is centred anew at the multipliers found until the targets are met; where no rates meet
them, what the T_k miss of w_k sum(T) is least by tokens, and nothing is repeated for the shares' sake alone.

Token totals are words as between white space. The decision is whole copies: floor(rate), and one
more where a hash of (doc_id, text) falls below the fraction.

Defined cases: null or empty text has no words and keeps rate max(1, min_rate); null source or lang
is a value of its own; without labels there is one domain, all rates stay 1; a doc_id labelled
several times counts each time, null labels not at all; targets for absent domains are dropped and
the rest rescaled; repeated rows each get the rate of their cell; very long texts are described whole; no rows
give no rows; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release

SOURCE_BUCKETS = 256
#: Residuals relative to the targets that count as met, the slack, and a bound on aggregates, at which a miss is reported.
TOLERANCE, EPSILON, STEPS, GRADIENT_STEPS = 1e-4, 1e-7, 200, 40
#: How often a growing total's slack is centred anew while its targets are missed.
CENTRES = 20
#: Gradient steps after which the driver lets go of their plans.
ROUNDS = 8
TARGETS = {"q1t0": 0.78, "q0t0": 0.13, "q1t1": 0.08, "q0t1": 0.01}
MAX_DOMAINS = 64
CELLS_PER_TASK = 100_000
LOG = logging.getLogger(__name__)
PROPERTIES = ("f_source", "f_lang", "f_length", "f_digits", "f_marks", "f_words", "f_lines")


def properties(docs: DataFrame) -> DataFrame:
    """n_tokens and the discretised properties of each row, beside its own columns.

    Counts are lengths after a replacement of whole runs, which makes no array of a text's parts.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    chars = F.length(t)
    share = lambda n: F.floor(F.log2(1 + n * 1024 / F.greatest(chars, F.lit(1)))).cast("int")
    tokens = F.length(F.regexp_replace(F.ltrim(t, F.lit(" \t\n\x0b\f\r")), "[^ \\t-\\r]+[ \\t-\\r]*", "w")).cast("long")
    without = lambda drop: chars - F.length(F.regexp_replace(t, drop, ""))
    made = {
        "f_source": F.pmod(F.xxhash64(F.coalesce("source", F.lit("\x00"))), F.lit(SOURCE_BUCKETS)).cast("int"),
        "f_lang": F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\x00"))), F.lit(SOURCE_BUCKETS)).cast("int"),
        "f_length": F.floor(F.log2(F.col("n_tokens") + 1)).cast("int"),
        "f_digits": share(without("[0-9]+")),
        "f_marks": share(without("[!?|{}\\[\\]<>#*=_@/]+")),
        "f_words": F.round(F.log2(1 + chars / F.greatest("n_tokens", F.lit(1)))).cast("int"),
        "f_lines": share(chars - F.length(F.replace(t, F.lit("\n")))),
    }
    # never null, so that a join on them doesn't compute them once more to filter nulls
    return docs.withColumn("n_tokens", tokens).withColumns({k: F.coalesce(c, F.lit(0)) for k, c in made.items()})


def domain() -> Column:
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def classifier(labelled: DataFrame) -> tuple[list[str], list[float], DataFrame]:
    """Domains, log priors, and (property, value, scores): log likelihoods as an array over the domains; a null value stands for all unseen ones."""
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()}
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names, total = list(counts), sum(counts.values())
    import math

    prior = [math.log(n / total) for n in counts.values()]
    values = labelled.select("domain", F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).alias("value")) for p in PROPERTIES))).alias("x")).select("domain", "x.*")
    known = values.groupBy("property", "value").agg(F.array(*(F.count_if(F.col("domain") == d) for d in names)).alias("n"))
    # hashed properties have SOURCE_BUCKETS values, the others those seen and one for all unseen
    sizes = known.groupBy("property").agg((F.count(F.lit(1)) + 1).alias("v")).withColumn("v", F.when(F.col("property").isin("f_source", "f_lang"), F.lit(SOURCE_BUCKETS)).otherwise(F.col("v")))
    score = lambda of: F.array(*(F.log((of(i) + 1) / (F.lit(float(counts[d])) + F.col("v"))) for i, d in enumerate(names))).alias("scores")
    sizes = F.broadcast(sizes)  # a row for each of PROPERTIES
    unseen = sizes.select("property", F.lit(None).cast("int").alias("value"), score(lambda _: F.lit(0)))
    return names, prior, known.join(sizes, "property").select("property", "value", score(lambda i: F.col("n")[i])).unionByName(unseen)


def cells(described: DataFrame) -> DataFrame:
    """One row for each combination of properties, with its documents and tokens."""
    return described.groupBy(*PROPERTIES).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def posteriors(cell: DataFrame, names: list[str], prior: list[float], scores: DataFrame) -> DataFrame:
    """cell with `posterior`, an array over names. scores has at most two source-sized and some small value ranges."""
    unseen = {r["property"]: r["scores"] for r in scores.where("value is null").collect()}  # a row for each of PROPERTIES
    out = cell.withColumn("log_p", F.array(*(F.lit(p) for p in prior)))
    for p in PROPERTIES:
        s = scores.where(F.col("property") == p).select(F.col("value").alias(p), F.col("scores").alias("s_"))
        out = out.join(s, p, "left").withColumn("log_p", F.zip_with("log_p", F.coalesce("s_", F.array(*map(F.lit, unseen.get(p, [0.0] * len(names))))), lambda a, b: a + b)).drop("s_")
    top = F.array_max("log_p")
    out = out.withColumn("w_", F.transform("log_p", lambda x: F.exp(x - top)))
    z = F.aggregate("w_", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("posterior", F.transform("w_", lambda x: x / z)).drop("log_p", "w_")


def stepped(steps: list[list[float]], min_rate: float) -> Column:
    """The rate of a cell after projected steps, each a weight of the step before and what each domain's share takes off."""
    if not steps:
        return F.lit(max(1.0, float(min_rate)))
    k = len(steps[0]) - 1
    flat = F.lit(np.array(steps, float).ravel())

    def step(s: Column, i: Column) -> Column:
        ahead = s["r"] + flat[i * (k + 1)] * (s["r"] - s["q"])
        off = sum((F.col("posterior")[j] * flat[i * (k + 1) + 1 + j] for j in range(k)), F.lit(0.0))
        return F.struct(F.greatest(F.lit(float(min_rate)), ahead - off).alias("r"), s["r"].alias("q"))

    one = F.lit(1.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.struct(one.alias("r"), one.alias("q")), step)["r"]


def _gradient(cell: DataFrame, now: np.ndarray, goal: np.ndarray, base: np.ndarray, min_rate: float, most: int) -> tuple[list[list[float]], np.ndarray]:
    """The projected gradient steps taken, and the totals after them."""
    k = len(now)
    p = [F.col("posterior")[i] for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(k) if i <= j]
    got = cell.agg(*(F.sum(F.col("tokens") * p[i] * p[j]) for i, j in upper)).first()
    gram = np.zeros((k, k))
    for (i, j), x in zip(upper, got):
        gram[i, j] = gram[j, i] = float(x or 0)
    inverse = np.linalg.inv(gram + 1e-9 * max(np.trace(gram), 1e-300) * np.eye(k))
    height = lambda t: (t - goal) @ inverse @ (t - goal) / 2
    steps: list[list[float]] = []
    before, sums, speed = now, now, 1.0
    for i in range(most):
        if np.abs((sums - goal) / base).max() <= TOLERANCE:
            break
        if i % ROUNDS == ROUNDS - 1:
            release(cell.sparkSession)  # plans of the steps so far
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        weight = (speed - 1) / faster
        ahead = sums + weight * (sums - before)  # totals are linear in the rates, projections apart
        trial = [*steps, [weight, *(inverse @ (ahead - goal))]]
        rated = cell.select("tokens", "posterior", stepped(trial, min_rate).alias("rate"))
        new = np.array([float(x or 0) for x in rated.agg(*(F.sum(F.col("tokens") * F.col("rate") * p[i]) for i in range(k))).first()])
        if weight and height(new) > height(sums):
            speed = 1.0
            continue
        steps, before, sums, speed = trial, sums, new, faster
    return steps, sums


def raw_rate(multipliers: list[float], lever: Column | None = None) -> Column:
    """The rate of a cell under the domains' multipliers, not yet bounded; lever: its tokens by its weight, where these differ."""
    dot = sum((F.lit(float(m)) * F.col("posterior")[i] for i, m in enumerate(multipliers)), F.lit(0.0))
    return 1 + (dot if lever is None else lever * dot)


def rate(multipliers: list[float], min_rate: float, lever: Column | None = None) -> Column:
    """The rate of a cell under the domains' multipliers."""
    return F.greatest(F.lit(float(min_rate)), raw_rate(multipliers, lever))


def fit_rates(cell: DataFrame, names: list[str], targets: dict[str, float], min_rate: float = 0.0, steps: int = STEPS, grow: bool = False) -> tuple[DataFrame, dict]:
    """cell with `rate`; and the totals before and after, with the residuals relative to the targets. grow: the total is what the rates nearest to 1 that meet the targets make it; a cell without docs is one document."""
    k = range(len(names))
    p = [F.col("posterior")[i] for i in k]
    upper = [(i, j) for i in k for j in k if i <= j]
    weight, lever = F.col("tokens"), None

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's own sum, the totals of the domains and their derivatives by the multipliers."""
        r = F.col("tokens") * F.col("rate")
        free = F.when(F.col("open_"), F.col("tokens") if lever is None else F.col("tokens") * lever).otherwise(0)
        # the integral of the rate along the multipliers, up to a constant
        height = F.when(F.col("open_"), F.col("raw_") * F.col("raw_") / 2).otherwise(min_rate * F.col("raw_") - min_rate * min_rate / 2)
        c = cell.withColumn("raw_", raw_rate(list(m), lever)).withColumn("open_", F.col("raw_") >= min_rate).withColumn("rate", rate(list(m), min_rate, lever))
        got = [float(x or 0) for x in c.agg(F.sum(weight * height), *(F.sum(r * p[i]) for i in k), *(F.sum(free * p[i] * p[j]) for i, j in upper)).first()]
        slope = np.zeros((len(k), len(k)))
        for (i, j), x in zip(upper, got[1 + len(k) :]):
            slope[i, j] = slope[j, i] = x
        return got[0], np.array(got[1 : 1 + len(k)]), slope

    now = [float(x or 0) for x in cell.agg(*(F.sum(F.col("tokens") * p[i]) for i in k)).first()]
    want = [max(0.0, targets.get(n, 0.0)) for n in names]
    if not sum(want) or not sum(now):
        return cell.withColumn("rate", F.lit(max(1.0, min_rate))), {"domains": names, "before": now, "target": now, "after": now, "residual": [0.0 for _ in k]}
    want = [w / sum(want) for w in want]
    if grow:
        docs = F.col("docs") if "docs" in cell.columns else F.lit(1)
        mean = sum(now) / cell.agg(F.sum(docs)).first()[0]
        weight = (F.col("tokens") + docs * F.lit(mean)) / 2
        lever = F.col("tokens") / weight
        m, sums = _grown(at, now, want, steps, cell.sparkSession)
        total = sums.sum()
    else:
        total = sum(now)
    goal = np.array([w * total for w in want])
    base = np.where(goal > 0, goal, total)
    if not grow:
        taken, sums = _gradient(cell, np.array(now), goal, base, min_rate, GRADIENT_STEPS)
        if np.abs((sums - goal) / base).max() <= TOLERANCE:
            LOG.info("targets are met after %d gradient steps", len(taken))
            return cell.withColumn("rate", stepped(taken, min_rate)), {"domains": names, "before": now, "target": goal.tolist(), "after": sums.tolist(), "residual": ((sums - goal) / base).tolist(), "gradient_steps": len(taken)}
        LOG.info("targets are not met after %d gradient steps; going on by multipliers", len(taken))
        m, sums = _multipliers(at, np.zeros(len(k)), goal, base, EPSILON * base * base / total, steps)
    residual = (sums - goal) / base
    if np.abs(residual).max() > TOLERANCE:
        LOG.warning("targets are missed; residuals relative to the targets: %s", dict(zip(names, residual.round(6).tolist())))
    return cell.withColumn("rate", rate(list(m), min_rate, lever)), {"domains": names, "before": now, "target": goal.tolist(), "after": sums.tolist(), "residual": residual.tolist()}


def _grown(at: Callable, now: list[float], want: list[float], steps: int, spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers of the rates nearest to 1 that give each domain its share of their own total, and the totals there."""
    w = np.array(want)
    total = max(n / x for n, x in zip(now, want) if x > 0)  # the least at which no domain has too much
    base = np.where(w > 0, w * total, total)
    slack = EPSILON * base * base / total
    over = np.eye(len(w)) - np.outer(w, np.ones(len(w)))  # from totals to what they are beyond their shares of the sum

    def beyond(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own, sums, slope = at(over.T @ m)
        return own, over @ sums, over @ slope @ over.T

    m = np.zeros(len(w))
    for _ in range(CENTRES):
        m, missed = _multipliers(beyond, m, slack * m, base, slack, steps)
        if np.abs(missed / base).max() <= TOLERANCE:
            break
        release(spark)  # plans of the steps so far
    m = over.T @ m
    return m, at(m)[1]


def _multipliers(at: Callable, m: np.ndarray, goal: np.ndarray, base: np.ndarray, slack: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The multipliers at which the dual is least, from m on, and the totals there."""
    dual = lambda m, own: own - goal @ m + (slack * m * m).sum() / 2
    own, sums, slope = at(m)
    step, length = None, 1.0
    for _ in range(steps):
        gradient = sums - goal + slack * m
        if np.abs(gradient / base).max() < TOLERANCE / 100:
            break
        if step is None:
            step, length = np.linalg.solve(slope + np.diag(slack), -gradient), 1.0
        new = m + length * step
        own_, sums_, slope_ = at(new)
        # near the end the dual's fall is lost in rounding, while the gradient's is not
        falls = dual(new, own_) <= dual(m, own) + 1e-4 * length * (gradient @ step)
        if falls or np.abs((sums_ - goal + slack * new) / base).max() < 0.5 * np.abs(gradient / base).max():
            m, own, sums, slope, step = new, own_, sums_, slope_, None
        else:
            length /= 2
    return m, sums


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, min_rate: float = 0.0, grow: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (keep: only these, and texts are then read once) as row_, with n_tokens, posterior, rate and copies for each row."""
    base = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row_"), "doc_id", "text", "source", "lang")
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    described = properties(base).withColumn("u_", u).drop("text", "source", "lang")
    lab = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").alias("l_id"), domain().alias("domain"))
    if keep is None:
        small = cut(described.select("doc_id", "n_tokens", *PROPERTIES))
    else:
        small = described = cut(described)
    labelled = cut(small.join(lab, small.doc_id == lab.l_id).select("domain", *PROPERTIES))
    names, prior, scores = classifier(labelled)
    if not names:
        names, prior = ["all"], [0.0]
    summed = cut(cells(small))
    tasks = -(-summed.count() // CELLS_PER_TASK) or 1  # each step scans the cells once
    cell = cut(posteriors(summed, names, prior, cut(scores)).repartition(tasks))
    release(docs.sparkSession)
    rated, _ = fit_rates(cell, names, TARGETS if targets is None else targets, min_rate, grow=grow)
    rated = cut(rated.select(*PROPERTIES, "posterior", "rate"))
    out = described.join(rated, list(PROPERTIES)).withColumn("copies", (F.floor("rate") + (F.col("u_") < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    return out.select("row_", "n_tokens", "posterior", "rate", "copies")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, min_rate: float = 0.0, grow: bool = False) -> DataFrame:
    """docs, each row as often as its copies say."""
    m = mix(docs, labels, targets, min_rate, grow)
    return m.where("copies > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), "copies"))).select("row_.*")
