"""Collocated phrases by stripes: each prefix keys an associative counter of the words that follow it.

A task cuts its texts into windows of words and makes, for each prefix that it sees, a stripe: the next words and how
often each followed. Stripes of one prefix are merged element by element. Elements are dealt to a fixed number of parts
by their phrases' keys, so that the stripe of a very common prefix is spread over many; a task sends a part all it has
for it in one block, and not a row for each prefix, of which more are frequent in more text. The stripe of the empty
prefix holds the words themselves, and its total is the number of words. All that is asked later is read from the merged
stripes: a phrase's own count is its element in the stripe of its prefix, the counts of its parts are elements of
shorter prefixes' stripes, and the most common longer phrase is the largest element of the phrase's own stripe (to the
right) or among the stripes that end in it (to the left).

A phrase occurs at most as often as any part of it, so stripes only count where the parts were frequent: first words,
then the pairs of frequent words by one hash, then exactly the phrases of two and three words, then those of four and
five. Tasks know the frequent parts from a bitmap of a fixed size; a bit that is set by chance costs a row and never
changes a count. Words and prefixes are 128-bit keys while they are counted, and get their words back by joins of the
frequent ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stillwave.llm.common import lean, small_batches, stash

#: Bits of the bitmap of frequent phrases, and so the most that a pass sends to each task (8 MB).
FILTER_BITS = 1 << 26
#: Words of a window, in which a task counts at once.
WINDOW = 250_000
#: Elements that a task holds before it adds them up; it hands them on if more than half are left.
HELD = 800_000
#: Elements are dealt to two to this power parts, by the highest bits of their phrases' keys.
DEAL_BITS = 10
#: Different words that a task keeps numbers for before it counts what it has and starts again.
KEPT_WORDS = 200_000
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Parts of a language whose best phrases are found before those of the language.
PARTS = 64

#: Ends of pieces become a point, which no word holds; a tab is a blank.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


Keys = tuple[np.ndarray, np.ndarray]


def longer(prefix: Keys, word: Keys) -> Keys:
    """Keys of the phrases that words make of prefixes; the order of words counts."""
    return tuple(mixed(p * step + w) for p, step, w in zip(prefix, _STEP, word))


def keys_of(words: list[bytes]) -> Keys:
    """128-bit keys of words, as two arrays."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64)
    return both[::2].copy(), both[1::2].copy()


def language_key(lang: str) -> Keys:
    """The key of the empty prefix of a language, from which all its phrases' keys are made."""
    return keys_of([lang.encode()])


def spots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the bitmap that stand for the first half of each key."""
    return tuple(((key >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for shift in (0, 32))


class Words(dict):
    """Word -> number, from 1; 0 is a point, the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.listed, self.keys = [b"."], (np.zeros(1, np.uint64), np.zeros(1, np.uint64))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.listed)
        self.listed.append(word)
        return number

    def all_keys(self) -> Keys:
        """Keys by number; only those of new words are made."""
        made = len(self.keys[0])
        if made < len(self.listed):
            self.keys = tuple(np.concatenate(pair) for pair in zip(self.keys, keys_of(self.listed[made:])))
        return self.keys


def slices(text: bytes):
    """A text in parts that end between words."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.find(b" ", at + SLICE), -1)
        point = text.find(b".", at + SLICE, end if end >= 0 else len(text))
        end = point if point >= 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def windows(batches, more: int):
    """(lang, words, numbers, starts): numbers of consecutive words, pieces ended by 0, of up to ``WINDOW`` starts.

    ``more`` words follow the last start, so that phrases across the border are seen once.
    """
    words, held, total = Words(), {}, 0

    def counted(going_on=None):
        for lang, parts in held.items():
            numbers = np.concatenate(parts)
            ends = len(numbers) - more * (lang == going_on)
            for at in range(0, ends, WINDOW):
                part = np.append(numbers[at:at + WINDOW + more], np.zeros(more, np.int32))
                yield lang, words, part, min(WINDOW, ends - at)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            tokens = []
            for part in slices(text.as_buffer().to_pybytes().lower().translate(_ENDS)):
                if total >= 4 * WINDOW or len(words) > 2 * KEPT_WORDS:
                    # Within a text: its last words are seen again, as what phrases may go on with and start from.
                    yield from counted(lang)
                    last = tokens[len(tokens) - min(more, len(tokens)):]
                    words, held, total = Words(), {}, 0
                    held[lang] = [np.fromiter(map(words.__getitem__, last), np.int32, len(last))]
                tokens = part.replace(b".", b" . ").split()
                held.setdefault(lang, []).append(
                    np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                total += len(tokens)
            held.setdefault(lang, []).append(np.zeros(1, np.int32))
            total += 1
            if total >= WINDOW:
                yield from counted()
                words, held, total = words if len(words) <= KEPT_WORDS else Words(), {}, 0
    yield from counted()


def first_stripes(docs: DataFrame) -> DataFrame:
    """Stripes of the empty prefix: (lang, word, n); the row without a word has the stripe's total."""
    def run(batches):
        held, known = {}, None

        def merged_rows():
            for lang, n in held.items():
                seen = np.flatnonzero(n[1:]) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(seen) + 1)),
                     pa.array([known.listed[i].decode() for i in seen] + [None], pa.string()),
                     pa.array(np.append(n[seen], n[1:].sum()), pa.int64())], names=["lang", "word", "n"])

        for lang, words, numbers, starts in windows(batches, 0):
            if words is not known:
                yield from merged_rows()
                held, known = {}, words
            n = np.bincount(numbers[:starts], minlength=len(words))
            n[:len(held.get(lang, ()))] += held.get(lang, np.zeros(0, np.int64))
            held[lang] = n
        yield from merged_rows()

    return docs.mapInArrow(lean(run), "lang string, word string, n long")


def frequent_starts(words: Words, lang: str, numbers: np.ndarray, starts: int, size: int, most: int, bits: np.ndarray):
    """Keys of the words and, for each place, of the phrase of ``size`` words there, and whether it is in the bitmap.

    ``most - size`` places after the last start are looked at too, for the phrases that go on.
    """
    n = starts + most - size
    word = tuple(k[numbers] for k in words.all_keys())
    whole = np.ones(n, bool)
    key = tuple(np.repeat(k, n) for k in language_key(lang))
    for i in range(size):
        key = longer(key, tuple(w[i:n + i] for w in word))
        whole &= numbers[i:n + i] > 0
    for spot in spots(key[0]):
        whole &= (bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) > 0
    return word, key, whole


def pair_hashes(docs: DataFrame, frequent) -> DataFrame:
    """(h, n): half the key of each pair of words in the bitmap ``frequent``, and its count."""
    def run(batches):
        bits = np.frombuffer(frequent.value, np.uint64)
        for lang, words, numbers, starts in windows(batches, 1):
            word, key, whole = frequent_starts(words, lang, numbers, starts, 1, 2, bits)
            at = np.flatnonzero(whole[:-1] & whole[1:])
            h, n = np.unique(longer((key[0][at],), (word[0][at + 1],))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return docs.mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def added_up(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Elements (p1, p2, w1, w2, n), each once with its whole count and its phrase's key (k1, k2), by which they go."""
    cols = [np.concatenate(parts) for parts in zip(*held)]
    k = longer(cols[:2], cols[2:4])
    order = np.lexsort(k[::-1])
    k1, k2 = k[0][order], k[1][order]
    edge = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    n = np.add.reduceat(cols[4][order], edge)
    return (*(c[order[edge]] for c in cols[:4]), n, k1[edge], k2[edge])


def blocks(batches, known: int, sizes: tuple[int, ...], bits: np.ndarray):
    """Stripes of the texts' prefixes, cut up: (part, elements), the rows p1, p2, w1, w2, n of a part's elements.

    For phrases of the given sizes (prefix and next word), where all parts of ``known`` words are in the bitmap.
    """
    most = max(sizes)
    held, total = [], 0

    def cut_up(p1, p2, w1, w2, n, k1, _):
        part = (k1 >> np.uint64(64 - DEAL_BITS)).astype(np.int32)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = np.stack([p1, p2, w1, w2, n], axis=1)
        offsets = (np.append(edge, len(part)) * rows.itemsize * rows.shape[1]).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
        batch = pa.RecordBatch.from_arrays([pa.array(part[edge]), cut], names=["part", "elements"])
        for at in range(0, len(edge), 128):
            yield batch.slice(at, 128)

    for lang, words, numbers, starts in windows(batches, most - 1):
        word, _, whole = frequent_starts(words, lang, numbers, starts, known, most, bits)
        prefix = tuple(np.repeat(k, starts) for k in language_key(lang))
        for size in range(1, most + 1):
            if size > known:  # whole where all parts from here on are
                whole = whole[:-1] & parts[size - known:]
            else:
                parts = whole
            if size in sizes:
                at = np.flatnonzero(whole[:starts])
                if len(at):
                    held.append((*(k[at] for k in prefix), *(w[at + size - 1] for w in word), np.ones(len(at), np.uint64)))
                    total += len(at)
            prefix = longer(prefix, tuple(w[size - 1:size - 1 + starts] for w in word))
        if total >= HELD:
            once = added_up(held)
            held, total = [once[:5]], len(once[0])
            if total > HELD // 2:
                yield from cut_up(*once)
                held, total = [], 0
    if held:
        yield from cut_up(*added_up(held))


def stripes(docs: DataFrame, known: int, sizes: tuple[int, ...], frequent) -> DataFrame:
    """The ``blocks`` of all tasks."""
    def run(batches):
        yield from blocks(batches, known, sizes, np.frombuffer(frequent.value, np.uint64))

    return docs.mapInArrow(lean(run), "part int, elements binary")


def merged(of: DataFrame, least: int) -> DataFrame:
    """Elements of at least ``least`` of the merged stripes: (p1, p2, w1, w2, n, k1, k2), k the phrase's key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, merge_at = [], 0, HELD
        for batch in batches:
            for block in batch.column("elements"):
                held.append(tuple(np.frombuffer(block.as_buffer(), np.uint64).reshape(-1, 5).T))
                total += len(held[-1][0])
                if total >= merge_at:  # what is held stays near the number of different elements
                    held = [added_up(held)[:5]]
                    total = len(held[0][0])
                    merge_at = max(HELD, 2 * total)
        cols = added_up(held)
        often = cols[4] >= least
        yield pa.RecordBatch.from_arrays([pa.array(c[often].view(np.int64)) for c in cols],
                                         names=["p1", "p2", "w1", "w2", "n", "k1", "k2"])

    return of.groupBy("part").applyInArrow(run, "p1 long, p2 long, w1 long, w2 long, n long, k1 long, k2 long")


def _keyed_words(words: DataFrame) -> DataFrame:
    """(lang, word, n) with the word's key (w1, w2) and its key as a phrase of the language (k1, k2)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = keys_of([x.encode() for x in batch.column("word").to_pylist()])
            p = keys_of([x.encode() for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(k.view(np.int64)) for k in (*w, *longer(p, w)))],
                names=[*batch.schema.names, "w1", "w2", "k1", "k2"])

    return words.mapInArrow(run, "lang string, word string, n long, w1 long, w2 long, k1 long, k2 long")


def _bitmap(frequent: DataFrame, key: str = "k1") -> bytes | None:
    """The bitmap of the keys, or None without any. The driver gets at most FILTER_BITS / 64 rows."""
    mask = F.lit(FILTER_BITS - 1).cast("long")
    spot = F.explode(F.array(F.col(key).bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))).alias("spot")
    rows = (frequent.select(spot).select(F.shiftright("spot", 6).alias("at"), F.expr("shiftleft(1L, int(spot & 63))").alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow())
    if not rows.num_rows:
        return None
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits.tobytes()


def counted(docs: DataFrame, least: int, most_words: int) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, size, n) of 1 to ``most_words`` words, and the words of each language (lang, n)."""
    spark = docs.sparkSession
    merged_words = first_stripes(docs).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = stash(merged_words.where((F.col("n") >= least) | F.col("word").isNull()))
    totals = first.where("word is null").select("lang", "n")
    words = stash(_keyed_words(first.where("word is not null")))
    named = {1: words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n", "k1", "k2")}

    def sent(frequent, key="k1"):
        bits = _bitmap(frequent, key)
        return bits and spark.sparkContext.broadcast(bits)

    frequent = sent(words)
    if frequent and most_words > 1:
        frequent = sent(pair_hashes(docs, frequent).where(F.col("n") >= least), "h")
    known, sizes = 2, (2, 3)
    while frequent and known <= most_words and sizes:
        found = stash(merged(stripes(docs, known, sizes, frequent), least))
        for size in sizes:
            prefix = named[size - 1].select("lang", F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                            F.col("phrase").alias("prefix"))
            word = words.select("lang", "w1", "w2", "word")
            named[size] = stash(found.join(prefix, ["p1", "p2"]).join(word, ["lang", "w1", "w2"]).select(
                "lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), F.lit(size).alias("size"), "n", "k1", "k2"))
        known, sizes = sizes[-1], tuple(x for x in (sizes[-1] + 1, sizes[-1] + 2) if x <= most_words)
        frequent = sent(named[known])
    phrases = None
    for part in named.values():
        phrases = part if phrases is None else phrases.union(part)
    return phrases.where(F.col("size") <= most_words).select("lang", "phrase", "size", "n"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most_words: int = 5,
                 share: int = 100, first: int = 2000) -> DataFrame:
    """Each language's ``first`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    Words are what blanks and tabs separate within pieces, pieces what ``.,;:!?`` and line ends separate, A-Z in lower
    case. ``a`` counts the phrase's occurrences (``least`` or more), ``l`` and ``r`` those of its two parts at the cut
    with the lowest score, the shortest first part at ties, ``n`` all words; score = floor(1000 a n / (l r)), exactly.
    A phrase goes if a longer one that holds it, of up to ``most_words`` words, has ``share`` percent of its
    occurrences or more. Ranks go by score, then ``a``, both descending, then phrase by UTF-8 bytes.

    A null text is empty, a null language is ``und``, as is a language of that name; repeated rows count each time;
    other columns are not looked at. Texts of any length are read in slices. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    phrases, totals = counted(docs, least, most_words)
    phrases = stash(phrases)
    split = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))

    # The largest longer phrase, to the right in the phrase's own stripe and to the left among the stripes ending in it.
    part = lambda a, n: F.array_join(F.slice("words", F.lit(a), n), " ")
    held = split.where("size > 2").select("lang", "n", F.explode(F.array(
        part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    alone = split.join(most, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < share * F.col("n")))

    # All cuts of what is left.
    cuts = (alone.select("lang", "phrase", F.col("n").alias("a"), "words", "size",
                         F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("head"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail")))
    of = lambda key, count: phrases.select("lang", F.col("phrase").alias(key), F.col("n").alias(count))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(totals, "lang")
              .withColumn("top", F.lit(1000).cast("decimal(5,0)") * (big("a") * big("n")).cast("decimal(33,0)"))
              .withColumn("bottom", big("l") * big("r")).withColumn("score", F.expr("top div bottom")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    # The best of each part of a language, then of the language, so that no task sorts all phrases of a common one.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    near = best.withColumn("place", F.row_number().over(parts)).where(F.col("place") <= first).drop("place")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= first).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
