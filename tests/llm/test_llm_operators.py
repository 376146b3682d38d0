"""Operators for training text against brute force on small tables, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from stillwave.llm import (byte_bpe, chat, common, lang_id, licences, mixing, near_dup, ngram_lm, nn_descent, pii,  # noqa: E402
                           spotsigs)
from stillwave.llm.licence_texts import LICENCES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, stock=("alpha", "beta", "gamma", "delta", "the", "of", "and", "house", "river", "stone", "über", "naïve")):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(stock) + str(rnd.randint(0, 30)) * (rnd.random() < 0.3) for _ in range(n))


def table(spark, texts, extra=True):
    """Documents with clashing extra columns."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("id", "t", "th", "n", "cls", "key", "size", "score", "pattern", "words")}) if extra else df


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"), (6, "  x"), (7, "ONE"),
           (8, "word " * 30_000), (9, "x" * 100_000), (10, "12345 " * 5_000), (None, "one"), (11, "é😀 中文 Привет"),
           (12, "a@b.co " * 2_000)]


# -- 1: mixing

def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    got = mixing.water_fill([10, 100, 1000], [3, 1, 1], 3)
    assert got[0] == 30 and abs(sum(got) - 1110) < 1e-9 and got[1] == 300
    assert mixing.water_fill([], [], 3) == [] and mixing.water_fill([0, 0], [1, 2], 3) == [0.0, 0.0]


def test_min_cost_flow_is_cheapest():
    rnd = random.Random(3)
    for _ in range(30):
        supply, demand = [rnd.randint(1, 3) for _ in range(2)], [rnd.randint(0, 5) for _ in range(2)]
        edges = [(0, 0), (1, 0), (1, 1)] + [(0, 1)] * (rnd.random() < 0.5)
        flow = mixing.min_cost_flow(supply, edges, demand, 3)

        def cost(total, one):
            return sum(min(max(total - r * one, 0), one) * r for r in range(3))
        best = None
        ranges = [range(0, 3 * supply[p] + 1) for p, _ in edges]
        import itertools
        for way in itertools.product(*ranges):
            out = [sum(f for f, (p, _) in zip(way, edges) if p == q) for q in range(2)]
            into = [sum(f for f, (_, s) in zip(way, edges) if s == q) for q in range(2)]
            if all(o <= 3 * c for o, c in zip(out, supply)) and all(i <= d for i, d in zip(into, demand)):
                key = (-sum(way), sum(map(cost, out, supply)))
                best = key if best is None else min(best, key)
        out = [sum(f for (p, _), f in flow.items() if p == q) for q in range(2)]
        assert (-sum(flow.values()), sum(map(cost, out, supply))) == best


def test_mix_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a"] if i % 3 else ["a", "b"], 10) for i in range(60)], "doc_id long, src array<string>, size long")
    mixed, flow = mixing.mix(docs, {"a": 300, "b": 400}, F.col("src"), F.col("size"))
    assert flow[("a", "b"), "b"] == 400 and flow[("a",), "a"] == 300
    rows = mixed.collect()
    assert sum(r.taken for r in rows) == 700 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    # Repeating is spread before it is deepened: 200 tokens give 400 as two each.
    assert {r.taken for r in rows if len(r.src) == 2} == {20}


def test_weighted_mix_of_awkward_rows(spark):
    rows = mixing.weighted(table(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source_size, []).append(r)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r["size"] for r in own)
    assert mixing.weighted(table(spark, [])).count() == 0
    # Small cells and many steps give what one ordering gives.
    docs = table(spark, [(i, words(i, i % 17)) for i in range(300)])
    plain = {r.doc_id: r.taken for r in mixing.weighted(docs).collect()}
    before, mixing.CELL_ROWS = mixing.CELL_ROWS, 1
    try:
        assert {r.doc_id: r.taken for r in mixing.weighted(docs).collect()} == plain
    finally:
        mixing.CELL_ROWS = before


# -- 2: near copies

def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(texts, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in texts]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) if s else i for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("block, small", [(128, 12), (4, 1)])
def test_near_duplicates_equal_brute_force(spark, block, small, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "SMALL", small)
    rnd, texts = random.Random(5), []
    for g in range(6):  # groups whose members are alike by different degrees, one of them large
        base = words(g, 60).split()
        for k in range(60 if g == 0 else 8):
            own = list(base)
            for _ in range(rnd.randint(0, 5)):
                own[rnd.randrange(len(own))] = f"edit{rnd.randint(0, 50)}"
            texts.append((len(texts), " ".join(own)))
    texts += [(1000 + i, words(100 + i, rnd.randint(1, 40))) for i in range(40)]
    rnd.shuffle(texts)
    got = {r.doc_id: r for r in near_dup.near_duplicates(table(spark, texts), size=3, percent=85).collect()}
    want = components(texts, 3, 85)
    assert [got[i].component_id for i, _ in texts] == want
    assert all(got[i].n_shingles == len(shingle_set(t, 3)) and got[i].kept == (i == c) for (i, t), c in zip(texts, want))


def test_near_duplicates_of_awkward_rows(spark):
    got = near_dup.near_duplicates(table(spark, AWKWARD), size=3, percent=85).collect()
    want = Counter((i, len(shingle_set(t, 3)), c) for (i, t), c in zip(AWKWARD, components(AWKWARD, 3, 85)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert near_dup.near_duplicates(table(spark, []), size=3, percent=85).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    seeds = rng.integers(1, 1 << 63, near_dup.BANDS * near_dup.ROWS, dtype=np.uint64) | np.uint64(1)
    pool = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)
    a, b = np.sort(pool[:1050]), np.sort(pool[50:])
    sa, sb = (near_dup.odd_sketch(near_dup.samples(x, seeds)) for x in (a, b))
    assert abs(near_dup.similarity_from_sketches(sa, sb, len(seeds)) - 1000 / 1100) < 0.08


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 9), (3, 1), (1, 1)], "a long, b long")
    assert {(r.node, r.root) for r in common.connected(edges).collect()} == {(3, 1), (4, 1), (5, 1), (8, 7), (9, 7)}


# -- 3: personal data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")),
                "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
    found = [(m.start(), place, m.end(), kind) for place, (kind, form) in enumerate(FORMS.items())
             for m in re.finditer(form, text or "") if good(kind, m.group())]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(9)
    parts = ["a@b.co", "x.y@z", "@", ".", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111",
             "4111111111111111", "+1 (988) 555-2485", "+4", "+49 30 1234567", " ", "é", "😀", "-", "a%b@c.d@e.f", "007.08.9.1", "+", "\n"]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(1500)]
    scanned = pii.scan(table(spark, texts + [(2000 + k, t) for k, (_, t) in enumerate(AWKWARD)]), "doc_id", "text")
    got = {r.id: [(s.start, s.end, s.kind) for s in r.base] for r in scanned.select("id", "base").collect()}
    for i, t in texts + [(2000 + k, t) for k, (_, t) in enumerate(AWKWARD)]:
        assert got[i] == base_spans(t), (t or "")[:200]


def test_contexts_discover_unseen_identifiers(spark):
    texts = [(i, f"{words(i, 20)} please mail to user{i}@mail.example.com for help {words(-i, 5)}") for i in range(40)]
    texts += [(100 + i, f"{words(i, 12)} please mail to bob{i % 2}@intranet for help") for i in range(6)]
    texts += [(200 + i, f"{words(i, 12)} chapter {i} of the book") for i in range(20)]
    rows = {r.doc_id: r for r in pii.find(table(spark, texts)).collect()}
    for i, t in texts:
        extra = [t[s.start:s.end] for s in rows[i].extra]
        assert extra == ([re.search(r"bob\d@intranet", t).group()] if 100 <= i < 200 else [])
        assert [(s.start, s.end, s.kind) for s in rows[i].base] == base_spans(t)
    done = {r.doc_id: r for r in pii.redact(table(spark, texts, False), n_chars="n_chars").collect()}
    for i, t in texts:
        want = re.sub(r"bob\d@intranet", "[EMAIL]", re.sub(FORMS["email"], "[EMAIL]", t))
        assert done[i].text == want and done[i].n_chars == len(want)


def test_redaction_of_long_and_awkward_texts(spark):
    long = "".join(f"{words(i, 3)} a{i}@b.co, 10.0.0.{i % 256}! " for i in range(900))
    texts = [*AWKWARD, (50, long), (51, "1.2.3.4@x.yz 4111 1111 1111 1111.2.3.4")]
    got = Counter((r.doc_id, r.text) for r in pii.redact(table(spark, texts)).collect())

    def redacted(t):
        if t is None:
            return None
        out, at = [], 0
        for s, e, k in base_spans(t):
            if s >= at:
                out += [t[at:s], f"[{k.upper()}]"]
            at = max(at, e)
        return "".join(out) + t[at:]
    assert got == Counter((i, redacted(t)) for i, t in texts)
    assert pii.redact(table(spark, [])).count() == 0


# -- 4: language model

def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 2_000)
    phrase = ("the stone house", "of gamma rivers", "alpha and delta", "naïve über beta")
    texts = [(i, " ".join(random.Random(i).choices(phrase, k=14))) for i in range(60)] + [(60, None), (61, ""), (62, "rare Token"), (62, "rare Token")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b"</>"]) for i, t in texts]
    one = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(one.values()), len(one)
    rows = ngram_lm.score(table(spark, texts), ~common.held_out("doc_id", 7, 2)).collect()
    assert len(rows) == len(texts)
    for i, ws in tokens:
        r = next(r for r in rows if r.doc_id == i)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in one for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score <= 0
    own = [r for r in rows if held(r.doc_id) and r.n_tokens > 10]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)  # better on texts it has not seen
    assert ngram_lm.score(table(spark, []), F.lit(True)).count() == 0
    assert {r.train_tokens for r in ngram_lm.score(table(spark, texts), F.lit(False)).collect()} == {0}


def test_expectation_maximisation_prefers_what_predicts():
    import pandas as pd
    cells = pd.DataFrame({"bucket": [3, 3], "two": [2, 0], "one": [20, 20], "n": [900, 100]})
    w = ngram_lm.learn_weights(cells, 1e-6)
    assert w[3][0] > 0.8 and abs(w[3].sum() - 1) < 1e-6 and np.allclose(w[2], [0, 0.5, 0.5])


def test_counts_are_packed_exactly():
    c = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (ngram_lm.large(ngram_lm.small(c), len(c)) == c).all()
    for v in (np.array([], "u8"), np.array([5, 6, 9], "u8"), np.array([1, 1 << 63], "u8")):
        assert (ngram_lm.spread(ngram_lm.squeezed(v)) == v).all()


# -- 5: language

STOCK = {"en": "the house is on that hill with many trees and water".split(), "de": "der schöne garten ist nicht für die große straße".split(),
         "ru": "это большой дом на высоком холме и река".split()}


def speech(lang, seed, n=30):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(STOCK[lang]) for _ in range(n))


def test_language_of_held_out_and_mixed_texts(spark):
    rows = [(i, speech(lang, i), lang, "s", 0) for i, lang in enumerate(list(STOCK) * 20)]
    docs = spark.createDataFrame(rows, DOCS)
    model = lang_id.learn(docs.where("doc_id % 5 <> 1"))
    got = lang_id.label(docs.drop("lang"), model).collect()
    assert all(r.lang_pred == list(STOCK)[r.doc_id % 3] and r.score > 0.9 for r in got)
    text = f"{speech('en', 1)} {speech('de', 2)} {speech('ru', 3)}"
    found = lang_id.spans(text, model)
    assert [s[2] for s in found] == ["en", "de", "ru"] and abs(found[0][1] - 30) <= 1 and found[1][1] == 60
    assert {(r.lang_pred, r.score) for r in lang_id.label(spark.createDataFrame([(1, "ελληνικά")], "doc_id long, text string"), model).collect()
            } <= {(lang, 0.0) for lang in STOCK}


def test_viterbi_equals_every_path():
    import itertools
    rng = np.random.default_rng(2)
    many = [rng.normal(size=(n, 3)) * 3 for n in (0, 1, 5, 7, 7, 3)]
    for own, got in zip(many, lang_id.viterbi(many, 1.5)):
        def value(path):
            return sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=len(own))), default=0)
        assert len(got) == len(own) and math.isclose(value(list(got)), best, abs_tol=1e-9)


def test_language_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "BLOCK", 50)
    docs = table(spark, AWKWARD)
    model = lang_id.learn(docs)
    rows = lang_id.label(docs, model).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.lang_pred == ("en" if any(c.isalpha() for c in r.text or "") else "und") for r in rows)
    assert {r.lang_pred for r in lang_id.label(docs, lang_id.learn(docs.where("false"))).collect()} == {"und"}
    assert lang_id.label(table(spark, []), model).count() == 0


# -- 6: nearest neighbours

def test_neighbours_by_graph_search(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "GROUP", 128)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype("f4")
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1),
                                                            (904, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (3, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = nn_descent.search(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        s = (x[q].astype("f8") * x.astype("f8")).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own) and q not in [r.vec_id for r in own]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(order)) if q not in (100, 120) else 10
    assert hits >= 0.9 * 10 * 35
    assert nn_descent.search(df.limit(0), F.lit(True)).count() == 0
    three = nn_descent.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0)
    assert {r.vec_id for r in three.collect()} == {1, 2}


def nearest(x, q, k):
    s = (x[q].astype("f8") * x.astype("f8")).sum(axis=1)
    return [int(i) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]


def found_by(spark, x, every, k):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nn_descent.search(df, F.col("vec_id") % every == 0, k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return {q: [i for _, i in sorted(own)] for q, own in got.items()}


def test_neighbours_of_equal_vectors_by_id(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "GROUP", 128)
    x = np.random.default_rng(5).normal(size=(1500, 16)).astype("f4")
    copied = range(1, 1500, 3)
    x[copied] = x[1]
    got = found_by(spark, x, 20, 10)
    assert list(got) and set(got) == set(range(0, 1500, 20))
    for q in set(got) & set(copied):
        assert got[q] == nearest(x, q, 10)  # copies come by id, and the query itself is left out
    assert sum(len(set(got[q]) & set(nearest(x, q, 10))) for q in got) >= 0.97 * 10 * len(got)


@pytest.mark.parametrize("spread", ["one long", "every norm", "two sizes"])
def test_neighbours_where_norms_differ_widely(spark, monkeypatch, spread):
    monkeypatch.setattr(nn_descent, "GROUP", 128)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    if spread == "one long":
        x[7] *= 300
    elif spread == "every norm":
        x *= 10 ** rng.uniform(-2, 2, size=(1500, 1))
    else:
        x[::2] *= 1000
    x = x.astype("f4")
    got = found_by(spark, x, 20, 10)
    assert len(got) == 75 and sum(len(set(own) & set(nearest(x, q, 10))) for q, own in got.items()) >= 0.97 * 750


# -- 7: fingerprints

def plain_signatures(text):
    import regex
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            chain = [y for y in w[i + 1:i + 1 + spotsigs.WINDOW] if y not in spotsigs.ANCHORS][:spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return out or ({tuple(w)} if w else {text} if text else set())


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "CHUNK_ROWS", 7)
    texts = [(i * 3, words(i, i % 50)) for i in range(200)] + [(700 + k, t) for k, (_, t) in enumerate(AWKWARD)] + [(5, "the big house")] * 2
    rows = spotsigs.fingerprints(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    order = sorted(texts, key=lambda r: -r[0])
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        if i == 5:
            continue  # equal rows follow each other
        r = next(r for r in rows if r.doc_id == i)
        a, b, c = map(plain_signatures, (t, edited, after))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, likeness(a, b)) and math.isclose(r.near_next, likeness(a, c))
        assert len([x for x in r.fingerprint.split(",") if x]) == len(a)
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert spotsigs.fingerprints(table(spark, [])).count() == 0


def test_similar_documents_by_length_partitions(spark):
    texts = [(i, words(i % 40, 60 + i % 7)) for i in range(120)] + [(500, "")]
    docs = table(spark, texts)
    got = {(r.query_id, r.doc_id) for r in spotsigs.similar(docs.where("doc_id % 10 = 0"), docs, 0.6).collect()}
    sigs = {i: plain_signatures(t) for i, t in texts}
    want = {(q, d) for q in sigs for d in sigs if q % 10 == 0 and sigs[q] and sigs[d]
            and len(sigs[q] & sigs[d]) >= 0.6 * len(sigs[q] | sigs[d])}
    assert got == want and len(want) > 20


# -- 8: byte-level BPE

def test_encoding_equals_a_public_tokenizer(spark):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(6)
    parts = ["a", "the", " the", "  ", "\n", " \n", "é", "中", "😀", "'s", "'ll", "12", "_", "##", "tion", " ", " ", "\x1f", "ß", "İ"]
    texts = [(100 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(400)] + AWKWARD
    rows = byte_bpe.encode_documents(table(spark, texts), path, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = other.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(table(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_transducer_with_few_states_and_commits():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    machine, rnd = byte_bpe.Transducer(ranks, most=50), random.Random(8)
    machine.longest = 1  # commits every 64 bytes
    plain = byte_bpe.Transducer(ranks)
    for _ in range(300):
        piece = bytes(rnd.choice(b"aabcdehinorst \xc3\xa9") for _ in range(rnd.randint(1, 300)))
        want = [ranks[t] for t in byte_bpe.merged(ranks, piece)] if piece not in ranks else [ranks[piece]]
        assert np.frombuffer(machine.encode(piece), "<u4").tolist() == want == np.frombuffer(plain.encode(piece), "<u4").tolist()


def test_streaming_decoder_on_any_bytes():
    rnd = random.Random(7)
    tokens = [bytes((i,)) for i in range(256)]
    for _ in range(3000):
        data = bytes(rnd.choice(b"a\x80\xa0\xbf\xc2\xe0\xed\xef\xf0\xf4\xff\x90\xe4\xb8\xad") for _ in range(rnd.randint(0, 9)))
        stream = byte_bpe.StreamDecoder(tokens)
        assert "".join(stream.feed([b]) for b in data) + stream.finish() == data.decode("utf-8", "replace")


# -- 9: chat

def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 2)
    said = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x<|im_end|>"), ("user", "bye")]
    rows = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 1), (5, 3)):
        rows += [(conv, t, *said[t]) for t in range(n)]
    rows += [(6, 1, "user", "hi"), (6, 2, "assistant", "other"), (7, None, "user", "z"), (None, 0, "user", "lost"), (8, 0, "user", "r"), (8, 0, "user", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(0), "pos": F.lit(0)})
    got = {r.conv_id: r for r in chat.maximal_conversations(turns).collect()}
    assert set(got) == {2, 6, 7, 8} and got[2].n_copies == 2 and got[2].n_turns == 5 and got[8].n_turns == 2
    assert got[2].rendered == "".join(f"<|im_start|>{r or 'unknown'}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for r, t in said)
    assert chat.maximal_conversations(turns.limit(0)).count() == 0


# -- 10: licences

def test_licences_in_other_dress(spark):
    mit, bsd = LICENCES[1][1], dict(LICENCES)["BSD-3-Clause"]
    texts = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace("\n\n", "\n").replace(" ", "  ")),
             (3, bsd.replace("license", "licence")), (4, mit + " and more"), (5, "text\nLicenced under CC BY-NC 4.0\ntext\nReleased under the MIT license!"),
             *[(100 + k, t) for k, (_, t) in enumerate(AWKWARD)], (6, "released under the MIT licence"), (6, "released under the MIT licence")]
    got = {}
    for r in licences.scan(table(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.notices, r.n_notices))
    assert sum(map(len, got.values())) == len(texts)
    assert got[1][0][0] == got[2][0][0] == "MIT" and got[3][0][0] == "BSD-3-Clause" and got[4] == [(None, "", 0)]
    assert got[5] == [(None, "CC-BY-NC-4.0,MIT", 2)] or got[5] == [(None, "MIT", 1)]
    assert got[6] == [("MIT", "MIT", 1)] * 2
    assert all(got[100 + k] == [(None, "", 0)] for k in range(len(AWKWARD)))
    assert licences.scan(table(spark, [])).count() == 0
