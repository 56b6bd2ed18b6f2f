"""Line dedup, suffix dedup, near duplicates and personal data against brute force, with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codepend.llm import common, line_dedup, minhash_dedup, pii, suffix_dedup

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_lines(rows, words=10, line_words=3):
    """Every run of 10 words or more, and every line of 3 or more, that also starts earlier goes."""
    firsts, found = {}, []
    for d, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        lines = (text or "").split("\n")
        n = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, min(len(lines), i + 60) + 1) if sum(n[i:j]) >= words]
        for i, j in [*runs, *((i, i + 1) for i in range(len(lines)) if n[i] >= line_words)]:
            key, at = tuple(lines[i:j]), (-(2**63) if d is None else d, i)
            firsts.setdefault(key, at)
            if firsts[key] < at:
                found.append((d, i, j))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        gone = {k for x, i, j in found if x == d for k in range(i, j)}
        out.append((d, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("part", [4096, 2])
def test_lines(docs, monkeypatch, part):
    rng = random.Random(1)
    passage = [prose(rng, rng.randint(1, 8)) for _ in range(6)]
    texts = [None, "", "\n\n", prose(rng, 3), "\n".join(["tick tock"] * 50)]
    for i in range(40):
        own = [prose(rng, rng.randint(0, 14)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            own[rng.randint(0, len(own)) : 0] = passage
        texts.append("\n".join(own))
    texts += [texts[-1], texts[7], "\n".join(passage), prose(rng, 30_000), "\n\n" + "\n".join(["", *passage, "", "x", "y"]), "z\n\n\n" + "\n".join(["", *passage, "", "x", "z"])]
    rows = [*enumerate(texts), (None, texts[6])]
    monkeypatch.setattr(common, "HOT_PART", part)
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs(rows)).collect()}
    assert len(got) == len(rows)
    for d, n, gone, left in brute_lines(rows):
        r = got[d]
        assert (r["n_lines"], r["n_removed"], r["text"]) == (n, gone, left)
        assert r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_lines_of_repeated_rows_and_shortened(docs):
    line = prose(random.Random(2), 12)
    same = docs([(1, line), (1, line), (2, line), (3, "own words\n" + line)])
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.deduplicated(same).collect()) == [(1, 0), (1, 0), (2, 1), (3, 1)]
    left = line_dedup.shortened(same.withColumnsRenamed({"score": "runs", "row_": "RID"}))
    assert left.columns[-2:] == ["runs", "RID"]
    left = line_dedup.shortened(same)
    assert left.columns == same.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()) == [(1, line, len(line))] * 2 + [(3, "own words", 9)]


def test_shortened_takes_whole_runs(docs):
    rng = random.Random(3)
    body = "\n\n" + "\n".join([prose(rng, 12), "", prose(rng, 15), "short end.", "x", ""])
    fork = prose(rng, 11)
    rows = [body, body, fork + "\nleft", fork + "\nright", fork + "\nright", "own\n" + body + "\nother", fork + "\n" + prose(rng, 4)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.shortened(docs(rows)).collect()}
    # an exact copy leaves no fragment; a run may equal a text that isn't the first with its window
    assert left == {0: body, 2: rows[2], 3: "right", 5: "own\nother", 6: rows[6].split("\n")[1]}


def test_shortened_takes_repeated_short_lines(docs):
    rng = random.Random(4)
    licence = ["All rights reserved.", "Licensed under CC BY-NC 4.0."]
    rows = ["\n".join([prose(rng, 12), *licence, "End.", prose(rng, 12)]) for _ in range(4)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.shortened(docs(rows)).collect()}
    assert left == {i: "\n".join(x for x in t.split("\n") if i == 0 or x not in licence) for i, t in enumerate(rows)}


def test_empty_tables(docs):
    none = docs([])
    for f in (line_dedup.deduplicated, line_dedup.shortened, suffix_dedup.repeats_removed, minhash_dedup.near_duplicates, minhash_dedup.distinct_documents, pii.personal_data, pii.sanitise):
        assert f(none).collect() == []


def brute_bytes(rows, length=100):
    seen, out = {}, {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if seen.setdefault(w, (d, k)) != (d, k):
                gone[k : k + length] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffixes(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = [None, "", "short", "é" * 99, "é" * 200, "ab" * 400, "x" * 5000]
    for i in range(30):
        t = prose(rng, rng.randint(1, 200))
        if i % 2:
            cut = rng.randint(0, len(passage) // 2)
            t = t[: len(t) // 2] + passage[cut : cut + rng.randint(60, 300)] + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[9], texts[9], texts[12][:-1] + "!", passage, passage[:99], prose(rng, 40_000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats_removed(docs(rows).repartition(5)).collect()}
    assert got == brute_bytes(rows)


@given(st.lists(st.text("ab", min_size=12, max_size=40), max_size=12), st.integers(0, 2))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_sorting(strings, shallow):
    raw = "".join(strings).encode()
    data, length = np.frombuffer(raw, np.uint8), 11
    starts = np.arange(max(0, len(raw) - length + 1))
    group = starts % 2
    got = suffix_dedup.equal_suffixes(data, starts, group, length, 8 * shallow)
    by = {}
    for s in starts:
        by.setdefault((s % 2, raw[s : s + length]), []).append(s)
    for members in by.values():
        assert len(set(got[members])) == 1 and (got[members[0]] == -1) == (len(members) == 1)
    named = [got[m[0]] for m in by.values() if len(m) > 1]
    assert len(set(named)) == len(named)


@given(st.lists(st.text("abc", min_size=6, max_size=6), max_size=40))
@settings(max_examples=60, deadline=None)
def test_blind_trie_sorts(strings):
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.insert(s.encode(), i)
    assert [strings[m[0]] for m in trie.in_order()] == sorted(set(strings))


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_near(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets}


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(docs, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 8000)
    rng = random.Random(4)
    texts = [None, "", "  \n", "One", "one", "a b c d", "A b\tc d", "É é", "é É"]
    for size in (8, 60, 300):
        base = prose(rng, size).split()
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                t[rng.randrange(size)] = rng.choice(WORDS)
            texts.append(" ".join(t))
    chain = prose(rng, 400).split()
    for i in range(8):
        chain = chain[3:] + [rng.choice(WORDS) for _ in range(3 + i % 2)]
        texts.append(" ".join(chain))
    texts += [prose(rng, 100) for _ in range(20)] + [texts[20], prose(rng, 30_000)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs(rows)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute_near(rows).items()}


def test_near_duplicates_with_shared_and_null_ids(docs):
    rng = random.Random(5)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [(3, a), (5, a), (5, b), (9, b), (None, a), (7, a), (7, a)]
    got = minhash_dedup.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (5, 3, False), (9, 3, False), (7, 3, False), (None, None, True)}
    assert sorted(str(r["doc_id"]) for r in minhash_dedup.distinct_documents(docs(rows)).collect()) == ["3", "None"]


def test_hyperminhash_estimates():
    rng = np.random.RandomState(0)
    for overlap in (0.5, 0.85, 1.0):
        errors = []
        for _ in range(20):
            n = 2000
            pool = rng.randint(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2)
            shift = int(n * (1 - overlap) / (1 + overlap))
            x, y = np.unique(pool[:n]), np.unique(pool[shift : shift + n])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            got, _ = minhash_dedup.estimate(minhash_dedup.registers(x), minhash_dedup.registers(y), np.int64(n), np.int64(n))
            errors.append(got - true)
        assert abs(np.mean(errors)) < 0.03


def brute_spans(t):
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d(m)) <= 19 and pii.luhn(d(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(d(m)) <= 15]
    return sorted(out)


@given(st.text("a1.2@-+ (9)_%0é\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_long_runs_of_digits():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.1.1") == [(0, 1, 5006)] and pii.base_spans(f"{zeros}256.1.1.1") == []
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []


def brute_terms(rows):
    """(row, start, end) of all disclosing terms, from the definition."""
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    docs = []
    for t in rows:
        t = t or ""
        base = brute_spans(t)
        words = [(fold(m[0]), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        free = [w for w in words if not any(s < w[2] and w[1] < e for s, _, e in base)]
        docs.append((t, {(k, t[s:e].lower()) for s, k, e in base}, {w[0] for w in words}, free))
    n, out = len(docs), set()
    for e in set().union(*(d[1] for d in docs)):
        with_e = [d for d in docs if e in d[1]]
        for w in {x[0] for d in with_e for x in d[3]}:
            both = [d for d in with_e if any(x[0] == w for x in d[3])]
            k, de, df = len({d[0] for d in both}), len(with_e), sum(w in d[2] for d in docs)
            if de < n and math.log(len(both) * n / (df * de)) / math.log(n / de) * (k / (k + 1)) ** 2 > pii.DISCLOSURE:
                out |= {(i, s, f) for i, d in enumerate(docs) if e in d[1] for x, s, f in d[3] if x == w}
    return out


def test_personal_data(docs):
    rng = random.Random(6)
    rows = [None, "", "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (456) 555-2186", "@" * 5000, "1" * 20_000]
    # `falke` stands in several different texts with one address, lines away from it, and nowhere else
    rows += [f"{prose(rng, 12)} Falke {prose(rng, 5)}\n{prose(rng, 12)}\njo@mail.example.com {prose(rng, 12)}" for _ in range(5)]
    rows += [prose(rng, 40) for _ in range(60)]
    # copies of one text are no evidence; an address in many texts, with and without a word of its own
    rows += [f"einmal x@y.org {prose(random.Random(1), 9)}"] * 6 + [f"{'immer' if i % 4 else 'nie'} {prose(rng, 6)} all@list.org" for i in range(20)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    for i, t in enumerate(rows):
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert [got[2][f"n_{k}"] for k in pii.KINDS[:4]] == [1, 1, 1, 1]
    terms = {(i, *map(int, x.split(":")[1:])) for i, r in got.items() for x in r["spans"].split(",") if x.startswith("term")}
    assert terms == brute_terms(rows)
    assert all((i, rows[i].index("Falke"), rows[i].index("Falke") + 5) in terms for i in range(5, 10))
    assert not any(i in (0, 1, 2, *range(10, 76)) for i, _, _ in terms)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(rows)).collect()}
    assert clean[0] is None and clean[2] == "mail [EMAIL] or [IP], card [CARD], call [PHONE]"
    assert "Falke" not in clean[6] and "[EMAIL]" in clean[6] and clean[20] == rows[20]
