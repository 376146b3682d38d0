"""SimHash blocks, conversation repair and collocations against brute force, on random and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stillwave.llm import collocations, common, repair, simhash

CLASHING = ("id", "fp", "least", "node", "root", "value", "key", "part", "n", "size", "words", "lang_", "copies", "kind")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING if c not in df.columns})


# -- 11: SimHash

def plain_fingerprint(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def plain_components(values, most):
    """Of each value the smallest one that links reach."""
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    of = np.array(values, np.uint64)
    for i in range(len(of)):
        for j in np.flatnonzero(np.bitwise_count(of ^ of[i]) <= most):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(of))]


def test_near_duplicates_by_simhash(spark):
    rnd = random.Random(2)
    stock = ["alpha", "Beta", "gamma", "delta", "the", "of", "über", "x" * 40]
    texts = []
    for _ in range(40):
        words = rnd.choices(stock, k=rnd.randint(1, 120))
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = rnd.choice(stock)
            texts.append("\t ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [
        (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1003, "one"), (1004, "ONE"), (None, "one"),
        (1005, "one two three"), (1006, "word " * 200_000), (1007, "word " * 199_000), (None, "alone here"), (1008, "é😀 中文")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = simhash.near_duplicates(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, 4)
    least = {}
    for (i, _), root in zip(rows, roots):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted([(i, f"{fp:016x}", least[root]) for (i, _), fp, root in zip(rows, fps, roots)], key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [3, 4])
def test_crowded_blocks_link_the_same_components(spark, most):
    rnd = random.Random(most)
    pool = set()
    for base in [rnd.getrandbits(64) for _ in range(2)]:
        for _ in range(200):
            value = base
            for _ in range(rnd.randint(0, 7)):
                value ^= 1 << rnd.randrange(64)
            pool.add(value)
    pool = sorted(pool)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in pool], "fp long")
    roots = {r.node: r.root for r in common.connected(simhash.links(nodes, most, len(pool))).collect()}
    groups = lambda keys: sorted(sorted(v for v, k in zip(pool, keys) if k == key) for key in set(keys))
    assert groups([roots.get(simhash.signed(v), simhash.signed(v)) for v in pool]) == groups(plain_components(pool, most))


def test_any_close_pair_shares_a_choice_of_blocks():
    rnd = random.Random(1)
    for most, n in ((4, 10), (4, 10 ** 5), (4, 10 ** 7), (3, 10 ** 9), (0, 100)):
        masks = simhash.choices(most, n)
        for _ in range(200):
            flip = sum({1 << rnd.randrange(64) for _ in range(most)})
            assert any(flip & m == 0 for m in masks)


def test_exploded_fingerprints_are_not_broadcast_by_estimate(spark):
    """Each fingerprint comes once for every choice of blocks, which the planner's sizes don't see."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "10m")
        spark.conf.unset(names[1])
        df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
        assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {0}
        nodes = common.stash(spark.range(50_000).select(F.xxhash64("id").alias("fp")))
        plan = simhash.links(nodes, 4, 50_000)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


# -- 12: conversation repair

def plain_repair(rows):
    """Per conversation the counts, least cost, least audit and digest, by a search that compares whole audits."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            end = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "dup" if (role, text) in seen else "cut" if end[-1] not in ".!?" else "")
            seen.add((role, text))

        def insert(layer):
            for _ in range(3):
                for state, after, line in (("", "u", "user:"), ("s", "u", "user:"), ("u", "a", "assistant:"), ("a", "u", "user:")):
                    if after in layer:
                        cost, audit, lines = layer[after]
                        way = (cost + 2, "I" + audit, (line, *lines))
                        if state not in layer or way < layer[state]:
                            layer[state] = way
            return layer

        layer = insert({"": (0, "", ()), "a": (0, "", ())})
        for (_, role, text), fault in zip(own[::-1], faults[::-1]):
            new = {}
            for state in ("", "s", "u", "a"):
                ways = []
                if state in layer:
                    ways.append((layer[state][0] + 3, "D" + layer[state][1], layer[state][2]))
                if fault not in ("blank", "dup"):
                    fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                    if role[:1] and role[0] in fits and role[0] in layer:
                        cost, audit, lines = layer[role[0]]
                        ways.append((cost + (fault == "cut"), "K" + audit, (f"{role}:{text}", *lines)))
                    if fits[-1] in layer:
                        cost, audit, lines = layer[fits[-1]]
                        name = {"u": "user", "a": "assistant"}[fits[-1]]
                        ways.append((cost + 2 + (fault == "cut"), "R" + audit, (f"{name}:{text}", *lines)))
                if ways:
                    new[state] = min(ways)
            layer = insert(new)
        cost, audit, lines = layer[""]
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                     faults.count("dup"), faults.count("cut"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def random_turns():
    rnd = random.Random(5)
    roles = [None, "", "system", "user", "user", "assistant", "assistant", "tool", "unknown"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(12)]), rnd.choice(roles),
             rnd.choice([None, "", "Hi.", "Why?", "so what", "  ", "Fine! ", "x"])) for _ in range(900)]
    rows += [(100, i, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", ""] + [f"{i}."] * 4))
             for i in range(300)]
    return rows + [(7, 3, "user", "Hi.")] * 40 + [(200, 1, "user", "long " * 50_000 + ".")]


def test_repair_of_conversations(spark):
    rows = random_turns()
    df = clashing(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: tuple(r[c] for c in COUNTS) for r in repair.repaired(df).collect()}
    assert got == plain_repair(rows)
    assert repair.repaired(df.limit(0)).collect() == []


def test_repair_over_short_segments(spark):
    """The same when nearly all conversations are cut into several segments."""
    rows = random_turns()
    damaged = repair.damaged(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text")
    got = {r.key: tuple(r[c] for c in COUNTS) for r in repair.repair(damaged, most_turns=7, most_chars=60).collect()}
    want = {"" if conv is None else f"c{conv}": row for conv, row in plain_repair(rows).items()}
    assert got == {key: want[key] for key in got} and len(got) >= len(want) - 1


def test_pointers_prefer_the_least_continuation():
    """Two arcs of one letter: the one whose continuation has the lower rank stays."""
    node, letter, target = np.array([0, 0, 1, 2]), np.array([2, 2, 3, 1]), np.array([1, 2, 3, 3])
    pointers, own, rank = repair.ranked_pointers(4, node, letter, target, 4)
    assert own.tolist() == [2, 3, 1, -1] and pointers[1][0] == 3 and pointers[-1].tolist() == [3] * 4
    assert np.argsort(rank).tolist() == [3, 2, 0, 1]


# -- 13: collocations

def plain_collocations(rows, least, most_words=5, first=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, most_words + 1):
                counts.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    often = {k: v for k, v in counts.items() if v >= least}
    out = {}
    for (lang, phrase), a in often.items():
        if len(phrase) < 2 or any(len(longer) > len(phrase) and other == lang and f >= a and any(
                longer[i:i + len(phrase)] == phrase for i in range(len(longer))) for (other, longer), f in often.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (often[lang, phrase[:k]] * often[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), often[lang, phrase[:k]], often[lang, phrase[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score) for lang, found in out.items()
                  for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1))


def phrase_rows():
    rnd = random.Random(9)
    stock = ["a", "B", "cc", "d", "é", "New", "york", "of", "the", "中文", "\xa0x"]
    rows = [(rnd.choice(["en", "de", None, "", "und"]),
             "".join(rnd.choice(stock) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ",", ""]) for _ in range(rnd.randint(0, 60)))
             + rnd.choice(["", " in New York city hall today", "x y x y x y"])) for _ in range(300)]
    return rows + [("en", None), ("en", ""), (None, " . ,"), ("en", "a b " * 30_000), ("en", "x" * 50_000)] + [("fr", "to be or not")] * 9


def test_collocations(spark):
    rows = phrase_rows()
    df = clashing(spark.createDataFrame(rows, "lang string, text string"))
    for least, most_words, first in ((9, 5, 2000), (4, 3, 5), (9, 2, 2000), (10 ** 9, 5, 10)):
        got = collocations.collocations(df, least=least, most_words=most_words, first=first)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, most_words, first)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_windows_cut_long_texts_without_loss(monkeypatch):
    """Counts are the same when windows, slices and known words are tiny."""
    import pyarrow as pa

    rnd = random.Random(4)
    rows = [("en", " ".join(rnd.choice("abcdefgh") + rnd.choice(["", ".", str(rnd.randint(0, 9))]) for _ in range(400))) for _ in range(6)]
    monkeypatch.setattr(collocations, "WINDOW", 37)
    monkeypatch.setattr(collocations, "SLICE", 50)
    monkeypatch.setattr(collocations, "KEPT_WORDS", 20)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["lang", "text"])
    for size in (1, 2, 5):
        seen = Counter()
        for _, words, numbers, starts in collocations.windows([batch], size - 1):
            for i in range(starts):
                if (numbers[i:i + size] > 0).all():
                    seen[b" ".join(words.listed[x] for x in numbers[i:i + size])] += 1
        want = Counter()
        for _, text in rows:
            for piece in text.split("."):
                words = piece.split()
                want.update(" ".join(words[i:i + size]).encode() for i in range(len(words) - size + 1))
        assert seen == want


def test_stripes_are_sent_in_blocks(spark):
    """Rows sent don't grow with the number of prefixes, nor with how often a prefix comes."""
    rnd = random.Random(5)
    rows = [("en", " ".join(f"w{rnd.randint(0, 20_000)}" for _ in range(30_000))) for _ in range(2)] * 2
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    every = spark.sparkContext.broadcast(b"\xff" * (collocations.FILTER_BITS // 8))
    sent = collocations.stripes(df, 2, (2, 3), every)
    assert sent.count() <= 4 * 2 ** collocations.DEAL_BITS
    got = collocations.merged(sent, 2)
    want = Counter()
    for _, text in rows:
        words = text.split()
        want.update(tuple(words[i:i + size]) for size in (2, 3) for i in range(len(words) - size + 1))
    often = sorted(n for n in want.values() if n >= 2)
    assert sorted(r.n for r in got.collect()) == often and len(often) > 1000
    assert got.select("k1", "k2").distinct().count() == len(often)


@pytest.mark.parametrize("held", [10, 300, 10 ** 6])
def test_blocks_add_up_to_all_places(monkeypatch, held):
    """Whether a task hands on often, adds up what it goes on holding, or does so once at its end."""
    import pyarrow as pa

    rnd = random.Random(6)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice("abcdefgh") + rnd.choice(["", "."]) for _ in range(500))) for _ in range(6)]
    monkeypatch.setattr(collocations, "WINDOW", 37)
    monkeypatch.setattr(collocations, "HELD", held)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], names=["lang", "text"])
    seen = Counter()
    for out in collocations.blocks([batch], 2, (2, 3), np.full(collocations.FILTER_BITS // 64, -1, np.int64).view(np.uint64)):
        for part, block in zip(out.column("part").to_pylist(), out.column("elements").to_pylist()):
            for *element, n in np.frombuffer(block, np.uint64).reshape(-1, 5):
                key = collocations.longer(*(tuple(np.array([x]) for x in pair) for pair in (element[:2], element[2:])))
                assert int(key[0][0]) >> (64 - collocations.DEAL_BITS) == part
                seen[tuple(element)] += int(n)
    want = Counter()
    for lang, text in rows:
        for piece in text.split("."):
            words = piece.encode().split()
            for size in (2, 3):
                for i in range(len(words) - size + 1):
                    prefix = collocations.language_key(lang)
                    for word in words[i:i + size - 1]:
                        prefix = collocations.longer(prefix, collocations.keys_of([word]))
                    want[tuple(k[0] for k in (*prefix, *collocations.keys_of([words[i + size - 1]])))] += 1
    assert seen == want
