"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

Features are hashed n-grams of letters (1 to 3, over text folded to lower case, other runs as one
blank), weighted by the inverse square root of their mean frequency. Every pair of classes, of
families first and of a family's languages then, has a linear support vector machine (squared
hinge, L2, fitted by accelerated gradient descent); most votes win, ties go to the greater sum of
margins. Languages whose family isn't listed form families of their own.

Machines learn from at most PER_LANGUAGE whole documents and BYTES_PER_LANGUAGE bytes of each
language, taken in the order of a hash of doc_id among the training rows with letters; a document that
doesn't fit in what is left is skipped, but of each language one is kept, the shortest if none fits.
Both bounds, and with them what the driver holds, are parameters: it keeps frequencies, not texts, and
copies those of two classes at a time, without the zeros of a matrix. There is a machine for each pair of
classes, so more than MAX_LANGUAGES languages are refused, not cut.

Defined cases: text that is null or has no letters is `und` with score 0; a null doc_id counts as
the empty string for the split; null langs are never learnt from; without training rows every text
is `und`; with one language every text with letters gets it; repeated rows each get a row; very long
texts are scored whole, in pieces of memory bounded by the text; no rows give no rows; other columns are
ignored, or kept as they are. The score is the logistic of the deciding margin, the least over the two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, release, slices, string_buffers

FEATURES = 1 << 13
PER_LANGUAGE = 600
BYTES_PER_LANGUAGE = 8_000_000
MAX_LANGUAGES = 64
SLICE = 1 << 19
ENTRIES = 1 << 16
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def _grams(offsets: np.ndarray, data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1, 2, 3 the feature at each byte of folded text, and the row bounds (rows + 1) in it."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    x = fold[data]
    is_letter = letter[x]
    first = np.zeros(len(x), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep |= first
    x = np.where(is_letter, x, 32).astype(np.uint32)[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[offsets]
    padded = np.concatenate([x, np.full(2, 32, np.uint32)])
    one = padded[:-2]
    two = one << np.uint32(8) | padded[1:-1]
    three = two << np.uint32(8) | padded[2:]
    spread = lambda v, k: (v * np.uint32(k) >> np.uint32(32 - 13)).astype(np.int32)
    return [spread(one + np.uint32(1), 0x9E3779B1), spread(two + np.uint32(7), 0x85EBCA77), spread(three + np.uint32(3), 0xC2B2AE3D)], bounds


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs for a byte of it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    grams, bounds = _grams(np.array([0, len(raw)]), raw)
    n = sum(np.bincount(g, minlength=FEATURES)[:FEATURES] for g in grams)
    at = np.flatnonzero(n)
    return at.astype(np.uint16), (n[at] / max(1, bounds[-1])).astype(np.float32)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear support vector machine with squared hinge; y is +-1.

    Rows are features and frequencies, to be multiplied by the scale; they are never spread out into a matrix, and what
    a step makes of them is bounded by ENTRIES or one row.
    """
    d = len(scale)
    ends = np.cumsum([0, *(len(at) for at, _ in rows)])
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([f for _, f in rows])
    parts = list(slices(ends, ENTRIES))
    for i, j in parts:
        x[ends[i] : ends[j]] *= scale[at[ends[i] : ends[j]]]

    def summed(values: np.ndarray, i: int, j: int) -> np.ndarray:
        """Sums of values (of the features of rows i to j) by row."""
        out, full = np.zeros(j - i), np.flatnonzero(np.diff(ends[i : j + 1]))
        if len(full):
            out[full] = np.add.reduceat(values, ends[i + full] - ends[i], dtype=np.float64)
        return out

    w, v, t = np.zeros(d + 1, np.float64), np.zeros(d + 1, np.float64), 1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    norms = np.concatenate([summed(x[ends[i] : ends[j]].astype(np.float64) ** 2, i, j) for i, j in parts])
    lipschitz = 2 * (weight * (norms + 1)).sum() + penalty
    for _ in range(steps):
        grad = penalty * v
        for i, j in parts:
            own, f = at[ends[i] : ends[j]], x[ends[i] : ends[j]]
            slack = np.maximum(0, 1 - y[i:j] * (summed(v[own] * f, i, j) + v[-1]))
            g = -2 * weight[i:j] * y[i:j] * slack
            grad[:-1] += np.bincount(own, np.repeat(g, np.diff(ends[i : j + 1])) * f, d)
            grad[-1] += g.sum()
        new = v - grad / lipschitz
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


class Model:
    """Machines for each pair of families and for each pair of a family's languages."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        mean = np.zeros(FEATURES)
        for at, n in rows:
            mean[at] += n
        scale = (1 / np.sqrt(np.maximum(mean / max(1, len(rows)), 1e-6))).astype(np.float32)
        lang, fam = np.array(langs), np.array([family(v) for v in langs])
        self.families = sorted(set(fam))
        self.within = {f: sorted(set(lang[fam == f])) for f in self.families}
        self.pairs, machines = [], []
        for labels, classes in [(fam, self.families), *((lang, self.within[f]) for f in self.families)]:
            for a, b in combinations(classes, 2):
                both = np.flatnonzero((labels == a) | (labels == b))
                machines.append(fit_machine([rows[k] for k in both], scale, np.where(labels[both] == a, 1.0, -1.0)))
                self.pairs.append((labels is fam, a, b))
        w = np.array(machines).reshape(-1, FEATURES + 1)
        self.bias = w[:, -1]
        self.weights = np.ascontiguousarray((w[:, :-1] * scale).astype(np.float32).T)

    def margins(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Margins of each row under each machine; rows are taken by SLICE bytes, so that arrays by byte stay small."""
        parts = [self._margins(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) for i, j in slices(offsets, SLICE)]
        return np.concatenate([np.zeros((0, len(self.pairs))), *parts])

    def _margins(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.pairs)
        out = np.zeros((n, k))
        if not k or not len(data):
            return out
        grams, bounds = _grams(offsets, data)
        full = np.flatnonzero(np.diff(bounds) > 0)
        for m in range(k):
            w = np.ascontiguousarray(self.weights[:, m])
            per_byte = w[grams[0]]
            per_byte += w[grams[1]]
            per_byte += w[grams[2]]
            out[full, m] = np.add.reduceat(per_byte, bounds[full], dtype=np.float64)
        return out / np.maximum(1, np.diff(bounds))[:, None] + self.bias

    def _vote(self, classes: list[str], top: bool, margins: np.ndarray) -> tuple[str, float]:
        if len(classes) == 1:
            return classes[0], np.inf
        votes, total, least = {c: 0 for c in classes}, {c: 0.0 for c in classes}, {c: np.inf for c in classes}
        for (is_top, a, b), m in zip(self.pairs, margins):
            if is_top == top and a in votes and b in votes:
                win = a if m >= 0 else b
                votes[win] += 1
                total[a] += m
                total[b] -= m
                least[win] = min(least[win], abs(m))
        best = max(classes, key=lambda c: (votes[c], total[c]))
        return best, least[best] if np.isfinite(least[best]) else 0.0

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        f, m1 = self._vote(self.families, True, margins)
        lang, m2 = self._vote(self.within[f], False, margins)
        low = min(m1, m2)
        return lang, 1.0 if not np.isfinite(low) else float(1 / (1 + np.exp(-4 * low)))


def held_out() -> F.Column:
    """Whether crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out."""
    share = 1 << 30
    rows = docs.where("lang is not null and text is not null").where(~held_out()).where(F.col("text").rlike("\\p{L}"))
    rows = rows.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(share)).alias("slot"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("least")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model([], [])
    # beyond the expected number of rows there is some room, so that the least hashes alone decide
    bound = lambda r: max(r["least"], int(share * min(1.0, 1.2 * per_language / r["n"])))
    limits = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], bound(r))))
    chosen = cut(rows.where(F.col("slot") <= limits[F.col("lang")]))
    sample, spare, size, taken = [], {}, {}, {}
    for r in chosen.orderBy("lang", "slot", "doc_id", "text").toLocalIterator():
        lang, n = r["lang"], len(r["text"].encode())
        if taken.get(lang, 0) >= per_language or not has_letters(r["text"]):
            continue
        if size.get(lang, 0) + n > bytes_per_language:
            if lang not in taken and (lang not in spare or n < spare[lang][0]):
                spare[lang] = n, (frequencies(r["text"]), lang)
            continue
        size[lang], taken[lang] = size.get(lang, 0) + n, taken.get(lang, 0) + 1
        spare.pop(lang, None)
        sample.append((frequencies(r["text"]), lang))
    sample += [row for _, row in spare.values()]
    release(docs.sparkSession)  # the sorted sample's texts, before the fit takes memory
    return Model([r[0] for r in sample], [r[1] for r in sample])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; keep: columns to carry along unchanged."""
    bounded_batches(docs.sparkSession, 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights for each pair of classes
    keep = keep or []
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("id_"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text_"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            text = b.column("text_")
            margins = m.margins(*string_buffers(text))
            lang, score = [], []
            for i, t in enumerate(text.to_pylist()):
                found = m.predict(margins[i]) if m.langs and has_letters(t) else ("und", 0.0)
                lang.append(found[0])
                score.append(found[1])
            cols = {"doc_id": b.column("id_")} if "doc_id" not in keep else {}
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in keep}, **cols, "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *([] if "doc_id" in keep else ["doc_id long"]), "held_out boolean, lang_pred string, score double"])
    return rows.mapInArrow(work, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the training rows, then predict every row."""
    return identify(docs, learn(docs))


def retained(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language the model can tell, unchanged; `und` is rejected."""
    bounded_batches(docs.sparkSession, 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights for each pair of classes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            text = b.column("text").fill_null("")
            margins = m.margins(*string_buffers(text))
            keep = [bool(m.langs) and has_letters(t) and m.predict(margins[i])[0] != "und" for i, t in enumerate(text.to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
