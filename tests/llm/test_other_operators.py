"""Chat formatting, top-k search, BPE, embeddings, language identification, mixing and the pipeline."""

import hashlib
import math
import random
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from codepend.llm import bpe, chat_format, common, embed_dedup, lang_id, mixing, topk_search
from codepend.llm.queries import TRICKY

EMBEDDINGS = "vec_id long, embedding array<double>, label int, score string"


@given(st.lists(st.tuples(st.text("\\#/<>turn:é \n", max_size=20), st.text("\\#/<>turn:é \n", max_size=40)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_template_round_trip(rows):
    made, bounds = chat_format.assemble(pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string()))
    for (role, text), out, (_, i, j) in zip(rows, made.to_pylist(), bounds):
        raw = out.encode()
        assert chat_format.parse(raw) == (role.encode(), text.encode())
        assert chat_format.unescape(raw[i:j]) == text.encode()
        assert raw.count(b"</turn>") == 1 and raw[i:j].count(b"###") == 0


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", TRICKY), (1, 2, "assistant", None), (2, None, None, None), (2, 0, "assistant", "#####" * 500), (None, 0, "a:b", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat_format.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert len(got) == 4
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = [(role, text) for _, _, role, text in turns]
        loss = "".join(text for role, text in said if role == "assistant")
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_mask_is_read(spark):
    """The loss text is what mask and bounds of the formatted rows say; clashing columns and empty tables do no harm."""
    df = spark.createDataFrame([(1, 0, "user", "q", "x", "y"), (1, 1, "assistant", "a\\b", "x", "y")], "conv_id long, turn long, role string, text string, formatted string, in_loss string")
    made = chat_format.format_turns(df)
    assert [(r["in_loss"], r["formatted"][r["text_start"] : r["text_end"]]) for r in made.orderBy("turn").collect()] == [(False, "q"), (True, "a\\\\b")]
    turned = made.withColumn("in_loss", ~F.col("in_loss"))
    assert [r["loss_sha256"] for r in chat_format.read_back(turned).collect()] == [hashlib.sha256(b"q").hexdigest()]
    assert [r["loss_chars"] for r in chat_format.read_back(made).collect()] == [3]
    assert chat_format.chat_digests(df.limit(0)).collect() == []


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q})[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 64)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    rng = np.random.RandomState(7)
    rows = [(i, rng.normal(0, 1 / 3, 9).tolist()) for i in range(300)]
    rows += [(i, (np.array(rows[i % 100][1]) * (1 + i % 7)).tolist()) for i in range(300, 420)]
    rows += [(500, [0.0] * 9), (550, []), (600, None), (601, [None] * 9), (602, [float("nan")] * 9), (650, [float("inf")] * 9), (700, [1.0, 2.0]), (701, [1e12] * 9), (None, [1.0] * 9)]
    rows += [(i, [-0.25] * 9) for i in range(800, 830)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], EMBEDDINGS)
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk_search.top_k(few, few.where("vec_id = 0"), 5).collect())) == brute_top(rows[:3])
    assert topk_search.top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_top_k_of_very_large_components(spark):
    """Whole numbers stay exact beyond 53 bits, and beyond the long range the order is that of the true values."""
    rows = [(0, [1e12, 3.0]), (1, [float(2**40 + 1), 1.0]), (2, [float(2**40), 300.0]), (3, [1e18, 0.0]), (4, [1e19, 0.0]), (5, [-1e19, 0.0]), (6, [-1e300, 0.0]), (7, [1e300, 1e300]), (8, [1e307, 0.0]), (50, [float(2**30), 1 / 256]), (100, [-5e306, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], EMBEDDINGS)
    got = topk_search.top_k(df, df.where("vec_id % 50 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(8)
    odd = ["\x1c\x85\u2028 a", "  x   y\t\n ", "don't we'll I'D", "日本語 テスト 123abc", "é\u0301🙂🙂", "<|endoftext|>", "'" * 300, "a" * 9000, " " * 5000]
    texts = [None, "", *odd, *("".join(rng.choice("ab cé1\n'🙂.") for _ in range(rng.randint(1, 300))) for _ in range(60)), "word " * 40_000]
    rows = [*enumerate(texts), (5, texts[5]), (5, "other"), (None, "no id")]
    got = bpe.tokenize(docs(rows).repartition(3), path, public_tokenizers.PATTERN, with_ids=True).collect()
    want = sorted((str(i), tok.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    plain = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert {r["decoded_sha256"] for r in got} == plain
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.tokenize(docs([]), path, public_tokenizers.PATTERN).collect() == []


def test_bpe_many_copies(spark, docs):
    """Rows that share a text share its ids, within a block and over several."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["one text", None, "", "an other\ntext"]
    rows = spark.range(70_000).coalesce(1).select("id", (F.col("id") * 7 % 4).alias("k"))
    named = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    many = rows.join(F.broadcast(named), "k").select(F.when(F.col("id") != 9, F.col("id")).alias("doc_id"), "text")
    alone = bpe.tokenize(docs(list(enumerate(texts))), path, public_tokenizers.PATTERN)
    want = {r["doc_id"]: tuple(r)[1:] for r in alone.collect()}
    got = bpe.tokenize(many, path, public_tokenizers.PATTERN).collect()
    assert len(got) == 70_000 and sum(r["doc_id"] is None for r in got) == 1
    assert all(tuple(r)[1:] == want[(9 if r["doc_id"] is None else r["doc_id"]) * 7 % 4] for r in got)


def brute_links(rows, threshold=0.9):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in ok}
    links = {k: [j for j in ok if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] for k in ok}
    label = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k, near in links.items():
            low = min([label[k], *(label[j] for j in near)])
            changed |= low != label[k]
            label[k] = low
    return sorted((str(i), len(links.get(k, ())), str(label[k])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("piece", [8192, 60])
def test_embeddings(spark, monkeypatch, piece):
    monkeypatch.setattr(embed_dedup, "PIECE", piece)
    monkeypatch.setattr(embed_dedup, "SHARD", 100)
    rng = np.random.RandomState(9)
    rows = []
    for g in range(12):
        base = rng.normal(0, 1, 16)
        rows += [base + rng.normal(0, 0.02 if g % 2 else 0.3, 16) for _ in range((3, 40)[g % 3 == 0])]
    rows += list(rng.normal(0, 1, (250, 16)))
    rows += [rows[0], rows[0], rows[1] * 7]
    rows = [(i, list(map(float, v))) for i, v in enumerate(rows)]
    rng.shuffle(order := list(range(len(rows))))
    rows = [(order[i], v) for i, v in rows]
    rows += [(900, None), (901, [0.0] * 16), (902, [None] * 16), (903, [float("nan")] * 16), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], EMBEDDINGS)
    got = embed_dedup.linked(df).collect()
    want = brute_links(rows)
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == sorted((w[0], w[1]) for w in want)
    assert {r["recall"] for r in got} == {1.0}
    assert sorted((str(r["vec_id"]), str(r["component_id"])) for r in got) == sorted((w[0], w[2]) for w in want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None) for r in got)
    assert embed_dedup.linked(df.limit(0)).collect() == []


def test_embedding_groups_of_all_sizes(spark):
    """Exact link counts, both ways, of groups of 2 to 700 different vectors around the threshold, beside others; nothing lost, nothing false."""
    rng = np.random.RandomState(19)
    rows = [rng.normal(0, 1, (1500, 24))]
    for size, spread in ((700, 0.02), (300, 0.06), (40, 0.06), *((k, 0.055) for k in (2, 3, 5) for _ in range(30))):
        rows.append(rng.normal(0, 1, 24) / np.sqrt(24) + rng.normal(0, spread, (size, 24)))
    x = np.concatenate(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    near = sims >= 0.9
    np.fill_diagonal(near, False)
    assert np.abs(sims - 0.9).min() > 1e-12
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], EMBEDDINGS).repartition(4)
    got = {r["vec_id"]: r for r in embed_dedup.linked(df).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.99 * near.sum()
    own = np.where(near.any(1))[0]
    assert np.mean(links[own] / near.sum(1)[own]) >= 0.97 and got[0]["recall"] >= embed_dedup.AIM


def test_labels_merge():
    label = np.arange(9)
    out = embed_dedup.merge(label, np.array([3, 4, 8, 1]), np.array([4, 8, 2, 1]))
    assert out.tolist() == [0, 1, 2, 2, 2, 5, 6, 7, 2]


def tongue(rng, lang, n):
    pieces = {"en": ["the", "and", "ing", "wh", "ly"], "de": ["der", "und", "sch", "keit", "ü"], "fr": ["le", "eau", "que", "é", "ç"], "es": ["el", "ción", "ñ", "os", "que"]}[lang]
    return " ".join("".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(docs):
    rng = random.Random(10)
    langs = [rng.choice(["en", "de", "fr", "es"]) for _ in range(240)]
    texts = [tongue(rng, x, rng.randint(5, 60)) for x in langs]
    extra = [None, "", "123 !?", "日本", tongue(rng, "de", 20_000)]
    df = docs([*enumerate(texts), *enumerate(extra, 300), (None, texts[0])], [*langs, *[None] * 6])
    got = {r["doc_id"]: r for r in lang_id.language_id(df).collect()}
    assert len(got) == 246 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    held = [i for i in range(240) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) > 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3 and got[300]["score"] == 0 and got[304]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = lang_id.learn(df)
    left = lang_id.retained(df, model)
    assert left.columns == df.columns and left.count() == 243
    assert lang_id.language_id(docs([])).collect() == []
    assert {r["lang_pred"] for r in lang_id.language_id(docs(["a b", None], [None, None])).collect()} == {"und"}


def test_machines_are_fitted_without_a_matrix(monkeypatch):
    """What a fit takes follows the features that rows have, not rows times FEATURES; weights are those of the dense formula."""
    rng = np.random.RandomState(21)
    langs = [x for x in ("en", "de", "fr") for _ in range(200)]
    rows = []
    for x in langs:
        at = np.sort(rng.choice(4000, 60, replace=False) + {"en": 0, "de": 1500, "fr": 3000}[x])
        rows.append((at.astype(np.uint16), rng.rand(60).astype(np.float32)))
    tracemalloc.start()
    model = lang_id.Model(rows, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * lang_id.FEATURES * 4 / 2  # half a matrix of two languages
    x = np.zeros((600, lang_id.FEATURES))
    for i, (at, n) in enumerate(rows):
        x[i, at] = n
    scale = (1 / np.sqrt(np.maximum(x.mean(0), 1e-6))).astype(np.float32)
    x, y = (x * scale)[:400], np.repeat([1.0, -1.0], 200)
    w, v, t = np.zeros(lang_id.FEATURES + 1), np.zeros(lang_id.FEATURES + 1), 1.0
    lipschitz = 2 * ((x**2).sum(1) + 1).sum() / 400 + 1e-4
    for _ in range(150):
        g = -2 * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) / 400
        new = v - (np.append(g @ x, g.sum()) + 1e-4 * v) / lipschitz
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    for entries in (64, 1000, lang_id.ENTRIES):
        monkeypatch.setattr(lang_id, "ENTRIES", entries)
        assert np.allclose(lang_id.fit_machine(rows[:400], scale, y), w, rtol=1e-4, atol=1e-6)
    empty = [(np.zeros(0, np.uint16), np.zeros(0, np.float32)), *rows[:1]]
    assert np.isfinite(lang_id.fit_machine(empty, scale, np.array([1.0, -1.0]))).all()


def test_every_language_is_learnt(docs):
    """Long texts that come first leave the other languages their share, and stay if a language has no others."""
    rng = random.Random(14)
    langs = ["de"] * 30 + ["en"] * 30 + ["fr"] * 30 + ["es"]
    texts = [tongue(rng, x, 300 if x == "de" else 40) for x in langs[:-1]] + [tongue(rng, "es", 5000)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][: len(langs)]
    df = docs(list(zip(ids, texts)), langs)
    model = lang_id.learn(df, bytes_per_language=3000)
    assert model.langs == ["de", "en", "es", "fr"]
    with pytest.raises(ValueError, match="languages"):
        lang_id.learn(df, max_languages=3)


def test_mixing_meets_targets(spark, docs):
    rng = random.Random(11)
    texts = [("!? {} " * 5 if i % 4 == 0 else "") + tongue(rng, "en", rng.randint(5, 80)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0, "x") for i in range(0, 400, 2)] + [(1, None, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    df = docs([*enumerate(texts), (400, None), (401, ""), (None, texts[1]), (7, texts[7])])
    targets = {"q0t0": 0.6, "q1t0": 0.4, "q1t1": 0.5}
    got = mixing.mix(df, labels, targets).collect()
    assert len(got) == 404
    share = sum(r["posterior"][0] * r["n_tokens"] * r["rate"] for r in got) / sum(r["n_tokens"] * r["rate"] for r in got)
    assert abs(share - 0.6 / 1.0) < 0.03 and min(r["rate"] for r in got) >= 0
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)
    grown = mixing.mixed_documents(df, labels, targets, min_rate=1.0, grow=True)
    assert grown.columns == df.columns
    assert {str(r["doc_id"]) for r in grown.collect()} == {str(r["doc_id"]) for r in df.collect()}
    assert {r["copies"] for r in mixing.mix(df, labels.limit(0)).collect()} == {1}
    assert mixing.mix(docs([]), labels).collect() == []


def test_mixing_meets_rare_targets(spark, caplog):
    """A domain of a hundredth gets what it is asked to; targets that can't be met are reported."""
    rng = random.Random(13)
    rows = [(1000 + rng.randrange(9000), [p, 1 - p]) for p in (rng.uniform(0.0, 0.06) ** 2 * 10 for _ in range(200))]
    cell = spark.createDataFrame(rows, "tokens long, posterior array<double>").cache()
    for targets, low, grow in (({"a": 0.02, "b": 0.98}, 0.0, False), ({"a": 0.002, "b": 0.998}, 0.0, False), ({"a": 0.02, "b": 0.98}, 1.0, True)):
        out, told = mixing.fit_rates(cell, ["a", "b"], targets, low, grow=grow)
        got = [r["tokens"] * r["rate"] * r["posterior"][0] for r in out.collect()]
        assert sum(got) == pytest.approx(told["target"][0], rel=1e-4) and min(r["rate"] for r in out.collect()) >= low
        assert max(map(abs, told["residual"])) < 1e-4
    assert not caplog.records
    _, told = mixing.fit_rates(cell, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert max(map(abs, told["residual"])) > 0.1 and "missed" in caplog.text


def test_mixing_takes_gradient_steps(spark):
    """The totals follow the same projected, accelerated steps as in numpy, and end at the targets; at most few cells are at the bound."""
    rng = np.random.RandomState(15)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.randint(1, 2000, 300)
    cell = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens long, posterior array<double>").cache()
    names, targets = ["a", "b", "c"], {"a": 0.55, "b": 0.4, "c": 0.05}
    out, told = mixing.fit_rates(cell, names, targets)
    assert 0 < told["gradient_steps"] <= mixing.GRADIENT_STEPS and max(map(abs, told["residual"])) <= mixing.TOLERANCE
    rate = np.array([r["rate"] for r in out.collect()])
    share = (n * rate) @ p / n.sum()
    assert np.allclose(share, [0.55, 0.4, 0.05], rtol=2 * mixing.TOLERANCE) and rate.min() >= 0
    goal, gram = np.array([0.55, 0.4, 0.05]) * n.sum(), (p * n[:, None]).T @ p
    inverse = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(3))
    r = q = np.ones(300)
    speed, steps = 1.0, 0
    while np.abs((n * r) @ p / goal - 1).max() > mixing.TOLERANCE:
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead = r + (speed - 1) / faster * (r - q)
        new = np.maximum(0, ahead - p @ (inverse @ ((n * ahead) @ p - goal)))
        height = lambda x: ((n * x) @ p - goal) @ inverse @ ((n * x) @ p - goal)
        if speed > 1 and height(new) > height(r):
            speed = 1.0
            continue
        r, q, speed, steps = new, r, faster, steps + 1
    assert steps == told["gradient_steps"] and np.allclose(np.sort(r), np.sort(rate), rtol=1e-6)


@pytest.mark.parametrize("size", [300, 3000])
def test_mixing_grows_in_proportion(spark, size):
    """Growing rates are the nearest to 1 by tokens and documents that meet the targets, so rows follow the input, not the few cells on the edge."""
    rng = np.random.RandomState(size)
    c = np.where(rng.rand(size) < 0.02, rng.uniform(0.001, 0.07, size), rng.uniform(0.075, 0.14, size))
    a = np.where(rng.rand(size) < 0.12, 0.99 - c, 0.03)
    p = np.stack([a, 1 - a - c, c], axis=1)
    docs = rng.randint(1, 30, size)
    n = (docs * np.exp(rng.normal(5, 1.5, size))).astype(int) + 1
    cell = spark.createDataFrame([(int(x), int(d), q.tolist()) for x, d, q in zip(n, docs, p)], "tokens long, docs long, posterior array<double>").cache()
    out, told = mixing.fit_rates(cell, ["a", "b", "c"], {"a": 0.13, "b": 0.78, "c": 0.08}, 1.0, grow=True)
    got = out.collect()
    n, docs, p, r = (np.array([x[k] for x in got]) for k in ("tokens", "docs", "posterior", "rate"))
    share = np.array([0.13, 0.78, 0.08]) / 0.99
    assert r.min() == 1 and np.allclose((n * r) @ p, share * (n @ r), rtol=mixing.TOLERANCE)
    assert np.allclose(told["after"], (n * r) @ p) and max(map(abs, told["residual"])) <= mixing.TOLERANCE
    lever = n / ((n + docs * n.sum() / docs.sum()) / 2)
    pull, up = (p - share) * lever[:, None], r > 1  # least where each rate is 1 + m . pull, or 1 where that is less
    m = np.linalg.lstsq(pull[up], r[up] - 1, rcond=None)[0]
    assert np.allclose(np.maximum(1, 1 + pull @ m), r, rtol=1e-6)
    assert docs @ r < 4 * docs.sum()


def test_mixing_posteriors_by_brute_force(docs, spark):
    """Naive Bayes with add-one smoothing, from the definition, over four domains with the real targets."""
    rng = random.Random(16)
    texts = [("!? {} " * (9 if i % 5 == 0 else 0)) + tongue(rng, "en", rng.randint(3, 70)) + (" 12345 99999" * 9 if i % 7 == 0 else "") for i in range(300)]
    df = docs(texts)
    rows = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 200)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    described = mixing.properties(df.select("doc_id", "text", "source", "lang")).collect()
    of = {r["doc_id"]: {p: r[p] for p in mixing.PROPERTIES} for r in described}
    domains = sorted({f"q{q}t{t}" for _, q, t in rows})
    members = {d: [i for i, q, t in rows if f"q{q}t{t}" == d] for d in domains}
    values = {p: mixing.SOURCE_BUCKETS if p in ("f_source", "f_lang") else len({of[i][p] for i, _, _ in rows}) + 1 for p in mixing.PROPERTIES}
    got = mixing.mix(df, labels, keep=["doc_id"]).collect()
    for r in got:
        own = of[r["row_"]["doc_id"]]
        log = [math.log(len(members[d]) / len(rows)) + sum(math.log((sum(of[i][p] == own[p] for i in members[d]) + 1) / (len(members[d]) + values[p])) for p in mixing.PROPERTIES) for d in domains]
        top = [math.exp(x - max(log)) for x in log]
        assert r["posterior"] == pytest.approx([x / sum(top) for x in top], rel=1e-9)
    total = sum(r["n_tokens"] for r in got)
    for k, d in enumerate(domains):
        assert sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in got) / total == pytest.approx(mixing.TARGETS[d], rel=2e-4)


def test_mixing_is_native(spark, docs):
    df = docs(["a b c", "d e"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    plan = mixing.mix(df, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_release_hands_native_memory_of_the_driver_back(spark):
    """200 MB freed in the JVM, but held by the allocator below a block in use, go back to the system."""
    jvm = spark.sparkContext._jvm
    platform, pid = jvm.org.apache.spark.unsafe.Platform, jvm.java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/status") as status:
            return next(int(x.split()[1]) for x in status if x.startswith("RssAnon")) / 1024

    common.release(spark)
    blocks = [platform.allocateMemory(100_000) for _ in range(2000)]
    for x in blocks:
        platform.setMemory(x, 1, 100_000)
    full = held()
    for x in blocks[:-1]:
        platform.freeMemory(x)
    common.release(spark)
    platform.freeMemory(blocks[-1])
    assert held() < full - 100


def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(12)
    lines = lambda n: "\n".join(tongue(rng, "en", 12) for _ in range(n))
    passage = lines(5)
    texts = [lines(6) for _ in range(30)] + [lines(3) + "\n" + passage for _ in range(4)] + ["!!! 123", passage]
    texts.append(texts[3])
    words = texts[4].split(" ")
    words[10] = "other"
    texts.append(" ".join(words).replace("\n", " "))
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(34))  # no letters; nothing but a repeat; an exact and a near copy


def test_pipeline_stages_with_odd_rows(spark, docs, tmp_path):
    """Nulls, empty texts, shared ids and clashing columns pass every stage; empty tables give no rows."""
    rng = random.Random(20)
    texts = [tongue(rng, "en", 30) for _ in range(6)]
    rows = [*enumerate(texts), (None, tongue(rng, "en", 30)), (7, None), (8, ""), (3, tongue(rng, "en", 30)), (9, "x\n" * 20_000 + texts[0])]
    odd = docs(rows).withColumnsRenamed({"score": "runs", "row_": "did"}).withColumn("lang", F.when(F.col("doc_id") == 1, None).otherwise(F.col("lang")))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("some", odd), ("none", odd.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, f"{tmp_path}/{name}")
            if k < 4:
                assert now.columns == odd.columns, stage
            now.write.parquet(f"{tmp_path}/{name}/{stage}")
            now = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        ids = {r["doc_id"] for r in now.collect()}
        assert ids == ({None, *range(6), 9} if name == "some" else set())
