"""The pipeline's rows against a brute-force version of its stages on a small table."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stillwave.llm import byte_bpe, mixing  # noqa: E402
from test_llm_operators import DOCS, FORMS, base_spans, components, speech  # noqa: E402


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts = [(i, speech(lang, i, 25 + i), lang) for i, lang in enumerate(["en", "de"] * 20)]
    texts += [(100 + i, t + " extra", lang) for i, t, lang in texts[:6]]  # near copies
    texts += [(200, "12 34 !!", "en"), (201, None, "en"), (202, "", "de")]  # no letter
    texts += [(300 + i, f"{speech('en', 50 + i, 40)} a{i}@mail.org and 10.0.0.{i} {speech('en', 90 + i)}", "en") for i in range(5)]
    rows = [(i, t, lang, None if i % 4 == 3 else f"s{i % 4}", len(t or "")) for i, t, lang in texts]
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())

    kept = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    kept = [(i, t) for (i, t), low in zip(kept, components(kept, 5, 80)) if i == low]
    assert len(kept) == 45
    clean = {}
    for i, t in kept:
        for s, e, k in reversed(base_spans(t)):
            t = f"{t[:s]}[{k.upper()}]{t[e:]}"
        clean[i] = t
    assert sum("[EMAIL]" in t and "[IP]" in t for t in clean.values()) == 5 and not any(re.search(FORMS["email"], t) for t in clean.values())
    source = {i: s for i, _, _, s, _ in rows}
    sizes = {i: len(t.split()) for i, t in clean.items()}
    names = sorted({s for s in source.values() if s}) + [None]
    totals = [sum(n for i, n in sizes.items() if source[i] == name) for name in names]
    quota = dict(zip(names, (int(t + 0.5) for t in mixing.water_fill(totals, [1, 2, 3, 1], 3))))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.read_ranks(
        public_tokenizers.path("byte_bpe_50k.tiktoken"))).encode_ordinary
    want = Counter()
    for name, total in zip(names, totals):
        rest = quota[name] % total
        for i in sorted((i for i in sizes if source[i] == name), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest()):
            more = max(0, min(sizes[i], rest))
            rest -= sizes[i]
            ids = encode(clean[i])
            times = int((quota[name] // total * sizes[i] + more) / sizes[i] + 0.5)
            if times:
                want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] = times
    assert got == want


def test_stages_keep_columns_and_take_nothing(spark):
    empty = spark.createDataFrame([], DOCS).withColumn("score", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_stages_with_filled_columns_of_any_name(spark):
    """Own columns named like helpers come through as they were, whatever they hold."""
    names = ("last", "cuts", "xid", "__times", "__copy", "__id", "_row", "score", "lang_pred", "n_spans", "cls", "_others",
             "component_id", "id", "name", "size", "taken", "base", "extra", "kind", "pattern", "first")
    rows = [(i, f"{speech('en', i, 30)} write to a{i}@mail.org", "en", f"s{i % 2}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        found = out.collect()
        assert out.columns == docs.columns and found
        assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
    assert pipeline.STAGES[-1][1](spark, docs, "").count() == 12


def test_one_row_of_each_class_stays(spark):
    text, other = speech("en", 1, 40), speech("de", 2, 40)
    rows = [(3, text), (3, text), (3, text), (None, text), (None, text + " more"), (4, text + " x"), (None, other), (None, other),
            (5, "  "), (6, None), (6, None), (9, other + " y"), (2, "one"), (2, "two words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, "").collect())
    assert got == Counter([(3, text), (9, other + " y"), (5, "  "), (6, None), (2, "one"), (2, "two words")])
