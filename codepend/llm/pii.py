"""Personal data: fixed patterns, and terms that reveal a protected value by co-occurrence.

The patterns find e-mail and IP addresses, card and phone numbers. Each value found is a protected
entity e; terms t (words as between white space, A-Z folded) within WINDOW words of any of its mentions,
on any line, are its context. With co, df and de the documents that hold both, the term and the entity,
over the whole corpus, a term discloses the part

    log(co N / (df de)) / log(N / de)

of the entity's information. An estimate from few documents says little, so the part is smoothed by
(k / (k + 1))^2, for k different texts that hold both: copies of one text are no evidence. Where the
smoothed part exceeds DISCLOSURE, the term becomes a span of kind `term` wherever it stands in a
document whose mentions have it in their context. Entities and terms that can't reach the limit with the texts they
have are left out of the search, which changes nothing. `sanitise` writes the generalised text:
patterns become their kind in brackets, terms are removed.

Defined cases: null text is empty; no findings give zeros, an empty `spans` and the digest of the
empty string; rows that repeat a doc_id each get a row with their own text's findings; an entity in
every document has no information to disclose; a long run of digits, leading zeros included, is judged
by its value; very long texts are searched whole, at a bounded multiple of their size, contexts being
WINDOW words at each mention; no rows give no rows; other columns, whatever their names, are ignored or
kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh, row_key, skewed_join, string_buffers, texts
from .minhash_dedup import word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, DISCLOSURE = 1000, 0.5
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts within a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part reaches left, at most to the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all patterns, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m[0].split("."))] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15] if "+" in text else []
    return sorted(out)


def entities_of(text: str, base: list[tuple[int, int, int]]) -> list[int]:
    """The entity of each span: a hash of its kind and its value, case aside."""
    return [xxhash.xxh3_64_intdigest(f"{KINDS[k]}:{text[s:e].lower()}".encode()) - 2**63 for s, k, e in base]


def terms_of(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Spans of all words, their hashes, and which of them touch no span of base (sorted by start)."""
    raw = text.encode()
    hashes = word_hashes(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))[0].view(np.int64)
    words = [m.span() for m in _WORD.finditer(text)]
    at = np.array(words, np.int64).reshape(-1, 2)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, _, e in base:
        i, j = int(np.searchsorted(at[:, 1], s, "right")), int(np.searchsorted(at[:, 0], e, "left"))
        edge[i] += 1
        edge[j] -= 1
    return words, hashes, np.cumsum(edge[:-1]) == 0


def contexts(text: str, base: list[tuple[int, int, int]], ents: list[int], wanted: set[int], window: int | None = None) -> list[tuple[int, np.ndarray]]:
    """(entity, distinct terms in its context) for each wanted entity of a text."""
    window = WINDOW if window is None else window
    words, hashes, free = terms_of(text, base)
    starts = np.array([w[0] for w in words], np.int64)
    near = {e: np.zeros(len(words) + 1, np.int64) for e in wanted}
    for (s, _, e), ent in zip(base, ents):
        if ent in near:
            near[ent][max(0, int(np.searchsorted(starts, s, "right")) - 1 - window)] += 1
            near[ent][min(len(words), int(np.searchsorted(starts, e, "left")) + window)] -= 1
    return [(e, np.unique(hashes[(np.cumsum(x[:-1]) > 0) & free])) for e, x in near.items()]


SPANS = "array<struct<s:int,k:int,f:int>>"
_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("f", pa.int32())]))


def _triples(spans: list[dict]) -> list[tuple[int, int, int]]:
    return [(x["s"], x["k"], x["f"]) for x in spans]


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, did, rid, base spans, their entities, a 128-bit hash of the text and, where there are spans, the text, for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, ents, b1, b2, kept = [], [], [], [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t)
                h = xxhash.xxh3_128_intdigest(t.encode()) if found else 1 << 63
                base.append([{"s": s, "k": k, "f": e} for s, k, e in found])
                ents.append(entities_of(t, found))
                b1.append((h >> 64) - 2**63)
                b2.append((h & (2**64 - 1)) - 2**63)
                kept.append(t if found else None)
            cols = [pa.array(base, _SPAN), pa.array(ents, pa.list_(pa.int64())), pa.array(b1, pa.int64()), pa.array(b2, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("did"), b.column("rid"), *cols], ["doc_id", "did", "rid", "base", "ents", "b1", "b2", "text"])

    bounded_batches(docs.sparkSession, 8)
    return docs.select("doc_id", "did", "rid", "text").mapInArrow(work, f"doc_id long, did long, rid long, base {SPANS}, ents array<long>, b1 long, b2 long, text string")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(t, df): in how many documents each term's hash occurs, counted over all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, words = word_hashes(*string_buffers(b.column("text")))
            own = [np.unique(h[i:j]) for i, j in zip(words[:-1], words[1:])]
            t, n = np.unique(np.concatenate(own) if own else h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "n"])

    return docs.select("text").mapInArrow(work, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def disclosing(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(did, rid, terms): spans of the terms that disclose too much of an entity that the row mentions."""
    n = found.count()
    own = found.where("text is not null")
    # equal texts are worked on once, with the number of their documents
    bodies = cut(own.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("copies"), F.any_value("text").alias("text"), F.any_value("base").alias("base"), F.any_value("ents").alias("ents")))
    mentions = cut(bodies.select("b1", "b2", "copies", F.explode(F.array_distinct("ents")).alias("e")))
    least = next(k for k in range(1, 10**6) if (k / (k + 1)) ** 2 > disclosure)  # fewer texts can't reach the limit
    entities = cut(mentions.groupBy("e").agg(F.count(F.lit(1)).alias("many"), F.sum("copies").alias("de")).where((F.col("many") >= least) & (F.col("de") < n)))
    wanted = skewed_join(mentions, entities, ["e"], mentions.count()).groupBy("b1", "b2").agg(F.collect_list("e").alias("wanted"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b1, b2, c, e, t) for b1, b2, c, text, base, ents, w in zip(*(b.column(x).to_pylist() for x in ("b1", "b2", "copies", "text", "base", "ents", "wanted"))) for e, t in contexts(text, _triples(base), ents, set(w))]
            size = [len(r[4]) for r in rows]
            cols = [np.repeat(np.array([r[k] for r in rows], np.int64), size) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.int64))], ["b1", "b2", "copies", "e", "t"])

    near = cut(bodies.join(wanted, ["b1", "b2"]).select("b1", "b2", "copies", "text", "base", "ents", "wanted").mapInArrow(around, "b1 long, b2 long, copies long, e long, t long"))
    together = near.groupBy("e", "t").agg(F.count(F.lit(1)).alias("many"), F.sum("copies").alias("co")).where(F.col("many") >= least)
    scored = together.join(entities.select("e", "de"), "e").join(document_frequencies(docs), "t")
    part = F.log(F.col("co") * F.lit(float(n)) / (F.col("df") * F.col("de"))) / F.log(F.lit(float(n)) / F.col("de"))
    flagged = cut(scored.where(part * F.pow(F.col("many") / (F.col("many") + 1), F.lit(2.0)) > disclosure).select("e", "t", "many"))
    terms = skewed_join(near, flagged, ["e", "t"], near.count()).groupBy("b1", "b2", F.col("copies").alias("many")).agg(F.collect_set("t").alias("terms"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, base, terms in zip(*(b.column(x).to_pylist() for x in ("text", "base", "terms"))):
                words, hashes, free = terms_of(text, _triples(base))
                out.append([{"s": words[k][0], "k": 4, "f": words[k][1]} for k in np.flatnonzero(np.isin(hashes, np.array(terms, np.int64)) & free)])
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("rid"), pa.array(out, _SPAN)], ["did", "rid", "terms"])

    marked = skewed_join(own.select("did", "rid", "text", "base", "b1", "b2"), terms, ["b1", "b2"], n)
    return marked.select("did", "rid", "text", "base", "terms").mapInArrow(mark, f"did long, rid long, terms {SPANS}").dropDuplicates(["did", "rid"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts, digests and all spans of each row, and did and rid, which tell rows with one doc_id apart."""
    rows = texts(docs)
    found = cut(find_base(rows))
    terms = disclosing(found, rows)
    kinds = F.array(*(F.lit(k) for k in KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["f"])), ",")
    found_of = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    counts = {f"n_{kind}": found_of(i) for i, kind in enumerate(KINDS[:4])}
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPANS))))
    out = found.select("doc_id", "did", "rid", "base").join(terms, ["did", "rid"], "left").withColumns(counts | {"base_sha256": F.sha2(written(F.col("base")), 256), "spans": written(every)})
    return out.select("doc_id", *counts, "base_sha256", "spans", "did", "rid")


def redact(text: str, spans: str) -> str:
    """The text with patterns generalised to their kind and terms removed; overlapping spans merge under the first's kind."""
    out, end = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        s, e = int(s), int(e)
        if s >= end:
            out += [text[end:s], "" if kind == "term" else f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with generalised texts; null texts stay null."""
    names = docs.columns
    did, rid, spans = (fresh(x, docs) for x in ("did", "rid", "spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else redact(t, s or "") for t, s in zip(b.column("text").to_pylist(), b.column(spans).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "text" else b.column(n) for n in names], names)

    found = personal_data(docs).select(F.col("did").alias(did), F.col("rid").alias(rid), F.col("spans").alias(spans)).dropDuplicates([did, rid])
    keyed = docs.withColumns(dict(zip((did, rid), row_key())))
    return keyed.join(found, [did, rid], "left").select(*names, spans).mapInArrow(work, docs.schema)
