"""Language of text: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Learning counts letter trigrams per language in hashed cells and, per language, the letters of each script. A word's
score for a language is the sum of its trigrams' log probabilities. Only languages that are written in the word's
script are candidates. Viterbi with a switching penalty then labels the words; a document's language is the one with
most labelled letters.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: First and last code point of the blocks of each script, from the Unicode character database.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF),
              (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
}
#: Cells that trigrams are hashed to; with the number of languages it bounds the model.
CELLS = 1 << 16
#: A language is a candidate in a script that has this share of its letters at least.
SCRIPT_SHARE = 0.01
#: What a change of language costs, in natural log units.
PENALTY = 12.0
#: Letters scored at a time; longer texts are scored in pieces, and Viterbi still runs over the whole.
BLOCK = 1 << 20


def letter_table() -> np.ndarray:
    """Code point -> 0 if it is no letter, else 1 + the number of its script (the last number: another script)."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = len(SCRIPTS) + 1
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            part = table[first:last + 1]
            part[part > 0] = number
    return table


def trigrams(text: str, kinds: np.ndarray):
    """Of all words (runs of letters): cell of each letter's trigram, first letter of each word, script of each word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = codes.astype(np.int64)
    kind = kinds[codes]
    letter = kind > 0
    padded = np.concatenate(([0], np.where(letter, codes, 0), [0]))
    mixed = (padded[:-2] * 0x9E3779B1 + padded[1:-1] * 0x85EBCA77 + padded[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    cells = ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 12 & (CELLS - 1)
    at = np.flatnonzero(letter)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return cells[at], first, kind[at][first] - 1 if len(at) else kind[:0]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Count trigrams and scripts of every labelled text; the model is bounded by ``CELLS`` x languages.

    Rows with a null text or language teach nothing. Each task adds up its rows before the shuffle, so a language with
    most rows is no hot key. Nothing to learn from gives a model without languages.
    """
    def count(batches):
        kinds, sums, scripts = letter_table(), {}, {}
        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                cells, first, script = trigrams(value.as_py(), kinds)
                if len(cells):
                    sums.setdefault(name, np.zeros(CELLS, np.int64))
                    sums[name] += np.bincount(cells, minlength=CELLS)
                    scripts.setdefault(name, np.zeros(len(SCRIPTS) + 1, np.int64))
                    lengths = np.diff(first, append=len(cells))
                    scripts[name] += np.bincount(script, lengths, len(SCRIPTS) + 1).astype(np.int64)
        for name in sums:
            full = np.concatenate((sums[name], scripts[name]))
            used = np.flatnonzero(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(full[used], pa.int64())],
                names=["lang", "cell", "n"])

    rows = (docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
            .mapInArrow(count, "lang string, cell long, n long")
            .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["lang"].unique())
    sums = np.zeros((len(langs), CELLS + len(SCRIPTS) + 1))
    sums[pd.Categorical(rows["lang"], langs).codes, rows["cell"]] = rows["n"]
    grams, scripts = sums[:, :CELLS], sums[:, CELLS:]
    used = max(1, int((grams.sum(axis=0) > 0).sum()))
    scores = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (used + 1)))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return {"langs": langs, "scores": np.ascontiguousarray(scores.T, np.float32), "scripts": (share >= SCRIPT_SHARE).T,
            "common": int(scripts.sum(axis=1).argmax()) if langs else -1}


def word_scores(text: str, model: dict, kinds: np.ndarray):
    """(scores of each word by language, letters of each word, whether it has candidates), and each word's script."""
    cells, first, script = trigrams(text, kinds)
    if not len(cells):
        return np.zeros((0, len(model["langs"])), np.float32), np.zeros(0, np.int64), np.zeros(0, bool)
    parts = []
    edges = [0]  # word starts near multiples of BLOCK letters
    for want in range(BLOCK, len(cells), BLOCK):
        edges.append(int(np.searchsorted(first, want)))
    edges.append(len(first))
    for a, b in zip(edges, edges[1:]):
        if b > a:
            stop = first[b] if b < len(first) else len(cells)
            parts.append(np.add.reduceat(model["scores"][cells[first[a]:stop]], first[a:b] - first[a], axis=0))
    scores = np.concatenate(parts)
    allowed = model["scripts"][script]
    known = allowed.any(axis=1)
    # A word in a script that no learned language uses says nothing; else other languages are out.
    scores = np.where(known[:, None], np.where(allowed, scores, scores - 1e4), 0)
    return scores, np.diff(first, append=len(cells)), known


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of every word of several texts at once; of equals the first language.

    Texts run side by side, longest first, so that a step handles one word of each text that is long enough.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    total, n_langs = int(lengths.sum()), scores[0].shape[1] if scores else 0
    if not total:
        return [np.zeros(0, np.int64) for _ in scores]
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.concatenate([scores[i] for i in order])
    stay, best = np.zeros((total, n_langs), bool), np.zeros(total, np.int16)
    now = flat[start[lengths > 0]].astype(np.float64)
    active = len(now)
    final = np.zeros((active, n_langs))
    for step in range(1, int(lengths[0])):
        alive = int(np.searchsorted(-lengths, -step, side="left"))  # texts with more than ``step`` words
        if alive < active:
            final[alive:active] = now[alive:active]
            now, active = now[:alive], alive
        at = start[:alive] + step
        top = now.argmax(axis=1)
        jump = now[np.arange(alive), top][:, None] - penalty
        keep = now >= jump
        stay[at], best[at] = keep, top
        now = np.where(keep, now, jump) + flat[at]
        now -= now.max(axis=1, keepdims=True)
    final[:active] = now
    label = np.zeros(total, np.int64)
    here = final.argmax(axis=1)
    for step in range(int(lengths[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-lengths, -step, side="left"))
        at = start[:alive] + step
        label[at] = here[:alive]
        if step:
            here[:alive] = np.where(stay[at, here[:alive]], here[:alive], best[at])
    out: list = [None] * len(scores)
    for place, i in enumerate(order):
        out[i] = label[start[place]:start[place] + lengths[place]]
    return out


def spans(text: str, model: dict, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
    """Language spans of one text: (start, end) in words (runs of letters) and the language."""
    scores, _, _ = word_scores(text, model, letter_table())
    labels = viterbi([scores], penalty)[0]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)] if len(labels) else [0]
    return [(int(a), int(b), model["langs"][labels[a]]) for a, b in zip(cuts, cuts[1:])]


def label(docs: DataFrame, model: dict, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``n_spans`` to every row; own columns of these names are replaced.

    ``lang_pred`` is the language of most letters (of equals the first name), ``score`` its share of all letters;
    ``und`` and 0 if the text is null, has no letter, or nothing was learned. Letters in scripts that no learned
    language uses count for none; if there are no others, the commonest language is named with score 0. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "n_spans")]
    # The text goes to the workers once, whether it is returned or not.
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{text}`")] * (text not in kept))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
                       + ["lang_pred string, score double, n_spans int"])

    def run(batches):
        model, kinds = sent.value, letter_table()
        langs = model["langs"]

        def results(group):
            out = []
            labels = viterbi([g[0] for g in group], penalty) if langs else [None] * len(group)
            for (scores, letters, known), labelled in zip(group, labels):
                if not len(letters) or not langs:
                    out.append(("und", 0.0, 0))
                    continue
                share = np.bincount(labelled[known], letters[known], len(langs))
                top = int(share.argmax()) if known.any() else model["common"]
                out.append((langs[top], float(share[top] / letters.sum()), int((np.diff(labelled) != 0).sum()) + 1))
            return out

        for batch in batches:
            done, group, held = [], [], 0
            for value in batch.column(text):
                group.append(word_scores(value.as_py() or "", model, kinds))
                held += len(group[-1][1])
                if held > BLOCK:  # bounds what Viterbi holds, whatever the batch
                    done += results(group)
                    group, held = [], 0
            done += results(group) if group else []
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "n_spans"])

    return rows.mapInArrow(run, schema)
