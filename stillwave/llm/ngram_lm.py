"""Scores of texts under an n-gram model with deleted interpolation.

Maximum-likelihood estimates of bigrams, unigrams and a uniform one are mixed; the mixture weights depend on how often
the context was seen, in buckets, and are learned by expectation-maximisation on counts that leave the token itself out.

Texts are packed to chunks of a bounded size. A chunk asks for the counts of its distinct n-grams, sorted by hash and
cut at fixed places into shards; a shard adds up what all chunks have of its n-grams and answers each chunk. So what is
shuffled is a few bytes for each distinct n-gram of a chunk, and no task holds more than a chunk or a shard.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwave.llm.common import small_batches, stash
from stillwave.llm.near_dup import WordHashes, mixed

#: Bytes of text of a chunk, and of the whole for each shard.
CHUNK_BYTES, SHARD_BYTES = 4_000_000, 16_000_000
#: Context-frequency buckets: powers of two of the count. Bins of the logarithms that expectation-maximisation sees.
BUCKETS, BINS, STEPS = 14, 96, 8
#: Rounds of expectation-maximisation at most, and the change of a weight that ends it.
EM_ROUNDS, EM_STOP = 500, 1e-7
#: Hash codes of the end of a text, and of the context before its first token.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Bits of a bigram's hash. A wrong count has probability (distinct bigrams) / 2^48 for a bigram.
PAIR_BITS = 48


def pack(docs: DataFrame, doc_id: str, text: str, train) -> DataFrame:
    """Chunks (chunk, size, starts, packed): bytes, training texts, and ids, texts and training flags of some rows as compressed Arrow data."""
    def run(batches):
        held, size = [], 0

        def flush():
            data = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([size], pa.int64()),
                 pa.array([sum(b.column("train").to_pylist().count(True) for b in held)], pa.int64()),
                 pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "starts", "packed"])

        for batch in batches:
            lengths = np.array([len(t.as_buffer()) for t in batch.column("t")], np.int64)
            at = 0
            while at < len(lengths):
                n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK_BYTES - size, side="right")))
                held.append(batch.slice(at, n))
                size += int(lengths[at:at + n].sum())
                at += n
                if size >= CHUNK_BYTES or at < len(lengths):
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), train.alias("train"))
    return rows.mapInArrow(run, "chunk string, size long, starts long, packed binary")


def unpack(packed: bytes, hashes: dict):
    """(ids, training flags, tokens of each text, code of every token, hash of every bigram) of a chunk."""
    data = pa.ipc.open_stream(packed).read_all()
    codes, sizes = [], []
    for value in data.column("t"):
        words = value.as_py().encode().lower().split()
        codes.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        codes.append(np.array([END]))
        sizes.append(len(words) + 1)
    codes, sizes = np.concatenate(codes), np.array(sizes)
    before = np.concatenate(([START], codes[:-1]))
    before[np.cumsum(sizes)[:-1]] = START
    pairs = mixed(before * np.uint64(0x9E3779B97F4A7C15) + codes) >> np.uint64(64 - PAIR_BITS)
    return data.column("id"), np.array(data.column("train").to_pylist(), bool), sizes, codes, before, pairs


def squeezed(sorted_values: np.ndarray) -> bytes:
    """Sorted integers in four bytes each where steps are small enough, else in eight."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    if len(steps) and int(steps.max()) < 1 << 32:
        return b"4" + steps.astype("<u4").tobytes()
    return b"8" + sorted_values.astype("<u8").tobytes()


def spread(data: bytes) -> np.ndarray:
    if data[:1] == b"4":
        return np.cumsum(np.frombuffer(data, "<u4", offset=1), dtype=np.uint64)
    return np.frombuffer(data, "<u8", offset=1)


def small(counts: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 and more follow in eight."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, "u1", n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return counts


def edges_of(n_shards: int, bits: int) -> np.ndarray:
    """Least hash of each shard but the first."""
    return np.array([(k << bits) // n_shards for k in range(1, n_shards)], np.uint64)


def ask(packed: DataFrame, n_shards: int) -> DataFrame:
    """Each chunk's distinct n-grams by shard, with its training counts. Kind 1 are tokens, 2 bigrams, 0 texts."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, train, sizes, codes, _, pairs = unpack(data.as_buffer(), hashes)
                flag = np.repeat(train, sizes)
                rows = []
                for kind, values, bits in ((1, codes, 64), (2, pairs, PAIR_BITS)):
                    own, place = np.unique(values, return_inverse=True)
                    counts = np.bincount(place, flag, len(own)).astype(np.int64)
                    cuts = [0, *np.searchsorted(own, edges_of(n_shards, bits)), len(own)]
                    rows += [(shard, kind, chunk, b - a, squeezed(own[a:b]), small(counts[a:b]))
                             for shard, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["shard", "kind", "chunk", "n", "values", "counts"])

    return packed.select("chunk", "packed").mapInArrow(
        run, "shard int, kind int, chunk string, n long, values binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """Each chunk's n-grams of a shard with their counts in all chunks; and a row without a chunk: tokens and types."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [spread(v) for v in pdf["values"]]
        values, place = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(place, np.concatenate([large(c, n) for c, n in zip(pdf["counts"], pdf["n"])]), len(values)).astype(np.int64)
        totals = np.split(counts[place], np.cumsum(pdf["n"].to_numpy())[:-1])
        shard, kind = pdf["shard"].iat[0], pdf["kind"].iat[0]
        rows = [(chunk, kind, shard, small(t), 0, 0) for chunk, t in zip(pdf["chunk"], totals)]
        rows.append((None, kind, shard, b"", int(counts.sum()), int((counts > 0).sum())))
        return pd.DataFrame(rows, columns=["chunk", "kind", "shard", "totals", "tokens", "types"])

    return asked.groupBy("shard", "kind").applyInPandas(
        run, "chunk string, kind int, shard int, totals binary, tokens long, types long")


def counted(packed, answers: list, n_shards: int, hashes: dict):
    """A chunk with counts: (ids, flags, sizes, c(token), c(context), c(bigram)); the context of a first token is -1."""
    ids, train, sizes, codes, before, pairs = unpack(packed, hashes)
    told = {(a["kind"], a["shard"]): a["totals"] for a in answers}
    own, place = np.unique(codes, return_inverse=True)
    pair, place2 = np.unique(pairs, return_inverse=True)
    out = []
    for kind, values, bits in ((1, own, 64), (2, pair, PAIR_BITS)):
        cuts = [0, *np.searchsorted(values, edges_of(n_shards, bits)), len(values)]
        out.append(np.concatenate([large(told[kind, shard], b - a) for shard, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]))
    at = np.minimum(np.searchsorted(own, before), len(own) - 1)
    context = np.where(own[at] == before, out[0][at], 0)
    context[before == START] = -1
    return ids, train, sizes, out[0][place], context, out[1][place2]


def _bins(f: np.ndarray) -> np.ndarray:
    """Bins of a relative frequency: 0 for none, then steps of 1 / STEPS of a factor of ten."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.clip(np.rint(-np.log10(np.maximum(f, 1e-300)) * STEPS), 0, BINS - 2) + 1, 0).astype(np.int64)


def _middle(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 10.0 ** (-(b - 1) / STEPS), 0.0)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then the powers of two of its count."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def learn_weights(cells: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) by bucket, by expectation-maximisation on held-out counts.

    ``cells``: bucket, bin of the bigram and of the unigram frequency, and tokens. A bucket without tokens takes the
    weights of the one below it, the lowest an even mix of unigram and uniform.
    """
    weights, last = np.zeros((BUCKETS, 3)), np.array([0.0, 0.5, 0.5])
    for b in range(BUCKETS):
        own = cells[cells["bucket"] == b]
        if len(own):
            parts = np.stack([_middle(own["two"].to_numpy()), _middle(own["one"].to_numpy()), np.full(len(own), uniform)], axis=1)
            n, now = own["n"].to_numpy(float), np.full(3, 1 / 3)
            for _ in range(EM_ROUNDS):
                share = parts * now
                share /= share.sum(axis=1, keepdims=True)
                new = n @ share / n.sum()
                done = np.abs(new - now).max() < EM_STOP
                now = new
                if done:
                    break
            last = now
        weights[b] = last
    return weights


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end of text. ``train`` tells which rows are
    learned from. ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` the model's log10 probabilities. A null
    text counts as empty: its end alone is scored. Repeated rows count as often as they come. Other columns are not
    looked at. An empty table gives an empty result; without training rows every token has the uniform probability.
    """
    small_batches(docs.sparkSession)
    packed = stash(pack(docs, doc_id, text, train))
    total, n_starts = packed.agg(F.sum("size"), F.coalesce(F.sum("starts"), F.lit(0))).first()
    n_shards = max(4, -(-(total or 0) // SHARD_BYTES))
    answers = stash(answer(ask(packed, n_shards)))
    facts = answers.where("chunk is null and kind = 1").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = int(facts[0] or 0), int(facts[1] or 0)
    by_chunk = answers.where("chunk is not null").groupBy("chunk").agg(
        F.collect_list(F.struct("kind", "shard", "totals")).alias("answers"))
    ready = stash(packed.select("chunk", "packed").join(by_chunk, "chunk").select("packed", "answers"))

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            for data, told in zip(batch.column("packed"), batch.column("answers")):
                ids, flags, sizes, one, context, two = counted(data.as_buffer(), told.as_py(), n_shards, hashes)
                yield ids, flags, sizes, one, np.where(context < 0, n_starts, context), two

    def cells(batches):
        full = np.zeros(BUCKETS * (BINS + 1) ** 2, np.int64)
        for _, flags, sizes, one, context, two in read(batches):
            own = np.repeat(flags, sizes)  # a training token is left out of the counts that judge it
            one, context, two = one[own] - 1, context[own] - 1, two[own] - 1
            seen = _bins(np.where(context > 0, two / np.maximum(context, 1), 0))
            place = (bucket(context) * (BINS + 1) + seen) * (BINS + 1) + _bins(one / max(1, n_tokens - 1))
            full += np.bincount(place, minlength=len(full))
        used = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(full[used], pa.int64())], names=["cell", "n"])

    # As many cells as buckets and bins allow, whatever the corpus.
    table = ready.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell = table["cell"].to_numpy(np.int64)
    weights = learn_weights(pd.DataFrame({"bucket": cell // (BINS + 1) ** 2, "two": cell // (BINS + 1) % (BINS + 1),
                                          "one": cell % (BINS + 1), "n": table["n"]}).sort_values(["bucket", "two", "one"]),
                            1 / (n_types + 1))

    def scores(batches):
        for ids, _, sizes, one, context, two in read(batches):
            lam = weights[bucket(context)]
            p = (lam[:, 0] * np.where(context > 0, two / np.maximum(context, 1), 0) + lam[:, 1] * (one / max(1, n_tokens))
                 + lam[:, 2] / (n_types + 1))
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            base = np.add.reduceat(np.log10((one + 1) / (n_tokens + n_types + 1)), first)
            columns = [ids.combine_chunks(), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((one > 0).astype(np.int64), first)),
                       pa.array(np.full(len(sizes), n_tokens, np.int64)), pa.array(base),
                       pa.array(np.add.reduceat(np.log10(p), first))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(scores, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
                            ).withColumnRenamed("id", doc_id)
