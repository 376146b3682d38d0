"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide.

Documents with equal shingle sets are one class and are represented by it, so copies never meet each other. MinHash
samples of a class are cut into bands; classes that share a band are candidates. The samples are also folded into an
odd sketch, a bitmap of parities: the population count of the XOR of two sketches tells how many samples differ. A
candidate whose sketches differ by more than any linked pair's plausibly do is dropped; the others are held against
their full sets.

Candidates are not all pairs of a bucket. First every member of a bucket is held against the bucket's smallest member,
which joins most of a large group into one component. Only then, in the buckets that still hold several components,
members outside the largest component are compared with the others, in blocks of bounded size, and each block returns
no more links than it has members. Within a component no further pair is looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stillwave.llm.common import connected, lean, small_batches, stash

#: MinHash bands and rows. A pair of similarity 0.85 shares no band with probability (1 - 0.85^6)^32, below 3e-7.
BANDS, ROWS = 32, 6
#: Bits of an odd sketch.
BITS = 512
#: Standard deviations below the expected sketch of a pair at the threshold at which a candidate is still looked at.
SIGMAS = 4.5
#: Members of a block when a bucket is compared block by block.
BLOCK = 128
#: Shingles of all members of a block, unless one member alone has more.
BLOCK_SHINGLES = 500_000
#: Parts that the pairs of one class are dealt to.
SALTS = 16
#: Buckets of up to so many members are compared by a join instead.
SMALL = 12
#: Word hashes a task keeps.
KEPT_WORDS = 100_000

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class WordHashes(dict):
    """Word -> 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text; fewer words than ``size`` are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = mixed(total * np.uint64(_MIX[i % 3] | 1) + codes[i:len(words) - size + 1 + i])
    return np.unique(total)


def samples(of: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash samples of a set: for each seed the least value of a 64-bit hash over the set."""
    out = np.full(len(seeds), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(of), 2048):  # bounds the matrix for a very long text
        part = (of[at:at + 2048, None] ^ seeds[None, ::2]) * seeds[None, 1::2]
        part ^= part >> np.uint64(29)
        low = part.min(axis=0)
        part = part * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(out[::2], low, out=out[::2])
        np.minimum(out[1::2], part.min(axis=0), out=out[1::2])
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit integers: each (place, value) flips one of ``BITS`` bits."""
    bit = mixed(values + np.arange(len(values), dtype=np.uint64) * np.uint64(_MIX[0])) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_flips(threshold: float, n_samples: int) -> int:
    """Bits that may differ between the sketches of two sets at the threshold, ``SIGMAS`` deviations above the mean.

    k samples differ with probability 1 - J each and each flips two of n bits: (1 - (1 - 2/n)^2m) n / 2 bits differ
    for m differing samples.
    """
    differing = n_samples * (1 - threshold)
    differing += SIGMAS * (n_samples * threshold * (1 - threshold)) ** 0.5
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differing))
    return int(mean + SIGMAS * (BITS / 4 * (1 - (1 - 2 / BITS) ** (4 * differing))) ** 0.5) + 1


def similarity_from_sketches(a: np.ndarray, b: np.ndarray, n_samples: int) -> float:
    """The similarity that two odd sketches stand for: 1 + n / 4k ln(1 - 2z / n)."""
    z = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of a negative number it would count the absolute value
    return max(0.0, 1 + BITS / (4 * n_samples) * float(np.log(max(1e-9, 1 - 2 * z / BITS))))


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Per row: id, ``cls`` (digest of the shingle set, null if empty), ``n``, band hashes and sketch."""
    def run(batches):
        hashes = WordHashes()
        rng = np.random.default_rng(20_170_401)
        seeds = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        rows = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(_MIX[1])
        for batch in batches:
            cls, n, bands, sketches = [], [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py(), size, hashes)
                n.append(len(own))
                if not len(own):
                    cls.append(None), bands.append(None), sketches.append(None)
                    continue
                cls.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                low = samples(own, seeds)
                keys = mixed((mixed(low.reshape(BANDS, ROWS) + rows)).sum(axis=1, dtype=np.uint64)
                             + np.arange(BANDS, dtype=np.uint64) * np.uint64(_MIX[2]))
                bands.append(keys.view(np.int64))
                sketches.append(odd_sketch(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "cls", "n", "bands", "sketch"])

    return (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
            .mapInArrow(lean(run), "id long, cls binary, n long, bands array<long>, sketch array<long>"))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(cls, set) of each text of the only column: the class as its set names it, the set as sorted packed 64-bit hashes."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(value.as_py(), size, hashes).tobytes() for value in batch.column(0)]
            cls = [hashlib.blake2b(own, digest_size=16).digest() for own in sets]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "set"])

    return texts.mapInArrow(lean(run), "cls binary, set binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    def run(batches):
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(batch.column("x"), batch.column("y"))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]],
                                             names=["a", "b"])

    # A class with very many pairs is dealt to several tasks, each with a copy of its set.
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = dealt.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    joined = (dealt.join(heads, ["a", "salt"])
              .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b"))
    return joined.select("a", "b", "x", "y").mapInArrow(lean(run), "a binary, b binary")


def _couples(members: DataFrame, percent: int, flips: int) -> DataFrame:
    """Candidates (a, b) of different components in buckets of at most ``SMALL`` members."""
    columns = ["key", "cls", "root", "n", "sketch"]
    one, two = (members.select("key", *[F.col(c).alias(f"{side}_{c}") for c in columns[1:]]) for side in "ab")
    return (one.join(two, "key").where("a_cls < b_cls and a_root <> b_root")
            .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
            .where(_flips("a_sketch", "b_sketch") <= flips)
            .select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct())


def _across(members: DataFrame, percent: int, flips: int) -> DataFrame:
    """Links between different components inside buckets: ``members`` has key, cls, root, minor, n, bands, sketch, set.

    The buckets' largest components are only met by the members outside them. Rows are dealt to pairs of blocks; a
    block pair holds at most about twice ``BLOCK`` rows, and twice ``BLOCK_SHINGLES`` shingles, and returns a spanning forest of the links that it finds.
    """
    # Blocks are bounded by their members and by their shingles.
    count = lambda part: F.greatest(F.ceil(F.count(F.when(part, 1)) / BLOCK),
                                    F.ceil(F.coalesce(F.sum(F.when(part, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES))
    sizes = members.groupBy("key").agg(count(F.col("minor")).alias("minors"), count(~F.col("minor")).alias("majors"))
    n_blocks = lambda c: F.greatest(F.lit(1), F.col(c))
    rows = members.join(sizes, "key").withColumn("spot", F.pmod(F.xxhash64("cls", "key"), F.lit(1 << 40)))
    own = rows.where("minor").withColumn("blk", F.col("spot") % n_blocks("minors"))
    minor_minor = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("minors") - 1))).select(
        "*", F.lit(0).alias("side"), F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j")).drop("o")
    minor_major = own.where("majors > 0").withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("majors") - 1))).select(
        *[c for c in own.columns], F.lit(1).alias("side"), F.col("blk").alias("i"), "j")
    major = rows.where("not minor").withColumn("blk", F.col("spot") % n_blocks("majors")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks("minors") - 1))).select(
        *[c for c in own.columns], F.lit(1).alias("side"), "i", F.col("blk").alias("j"))
    columns = ["key", "cls", "root", "minor", "n", "bands", "sketch", "set", "side", "i", "j"]
    dealt = minor_minor.select(columns).unionByName(minor_major.select(columns)).unionByName(major.select(columns))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls", ignore_index=True)
        key = pdf["key"].iat[0]
        sketch = np.array(pdf["sketch"].tolist(), np.int64).view(np.uint64)
        bands = np.array(pdf["bands"].tolist(), np.int64)
        size, minor = pdf["n"].to_numpy(), pdf["minor"].to_numpy()
        _, values = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in pdf["set"]]), return_inverse=True)
        first = np.cumsum(size) - size
        top = {root: i for i, root in enumerate(pdf["root"])}
        up = [top[root] for root in pdf["root"]]

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        found = []
        for i in np.flatnonzero(minor):
            others = np.flatnonzero((100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            others = others[(others > i) | ~minor[others]]
            others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1) <= flips]
            same = bands[others] == bands[i]
            # A pair that shares several bands is looked at in the first of them only.
            others = others[bands[others, same.argmax(axis=1)] == key]
            others = [j for j in others if find(i) != find(j)]
            if not others:
                continue
            # What every member has in common with this one, at once.
            own = np.zeros(int(values.max()) + 1, np.int32)
            own[values[first[i]:first[i] + size[i]]] = 1
            common = np.add.reduceat(own[values], first)
            for j in others:
                if 100 * common[j] >= percent * (size[i] + size[j] - common[j]) and find(i) != find(j):
                    up[find(i)] = find(j)
                    found.append((pdf["cls"].iat[i], pdf["cls"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("key", "side", "i", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``size``-word shingles (words
    between ASCII white space, A-Z lower-cased; fewer words are one shingle). ``component_id`` is the smallest id that
    links reach, ``kept`` whether it is the row's own. A null or wordless text has an empty set and links with nothing.
    Rows that share an id are one document of that id: each is answered, and all are kept or none. A row without an
    id gets the component of its text's class, and is kept only if no row with an id is in it. Other columns are
    not looked at. An empty table gives an empty one. ``percent`` is 80 or more: bands are laid out for that.
    """
    small_batches(docs.sparkSession)
    rows = stash(signatures(docs, doc_id, text, size))
    classes = stash(rows.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch")))
    flips = most_flips(percent / 100, BANDS * ROWS)

    # Classes that share a band with another class, and the bucket's smallest class.
    spread = classes.select("cls", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("low")).where("m > 1")
    members = stash(spread.join(buckets.select("key", "low"), "key"))
    sketches = classes.select("cls", "n", "sketch")
    pairs = (members.where("cls <> low").select(F.col("low").alias("a"), F.col("cls").alias("b")).distinct()
             .join(sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
             .join(sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
             .where(_flips("sa", "sb") <= flips).select("a", "b"))
    pairs = stash(pairs)

    # Full sets, only of classes that share a bucket; one document stands for its class.
    wanted = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", F.col("least").alias("id"))
    sets = stash(_texts_of(docs, doc_id, text, wanted, rows, size))

    links = _verify(pairs, sets, percent)
    roots = connected(links)
    placed = members.join(roots, members["cls"] == roots["node"], "left").select(
        "key", "cls", F.coalesce("root", "cls").alias("root"))
    # Buckets that hold more than one component; the largest component of each is its major one.
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    major = (parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("top"))
             .where("parts > 1").select("key", F.col("top.root").alias("major"), "m"))
    left = stash(placed.join(major, "key").select(
        "key", "cls", "root", (F.col("root") != F.col("major")).alias("minor"), "m")
        .join(classes.select("cls", "n", "bands", "sketch"), "cls"))
    few, many = left.where(F.col("m") <= SMALL), left.where(F.col("m") > SMALL)
    more = _verify(_couples(few, percent, flips), sets, percent).union(_across(many.join(sets, "cls"), percent, flips))
    roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # The smallest id of each component, by class; classes without links have their own.
    low = (classes.select("cls", "least").join(roots, F.col("cls") == F.col("node"), "left")
           .select("cls", "least", F.coalesce("root", "cls").alias("root")))
    tied = low.groupBy("root").agg(F.min("least").alias("component_id"))
    named = low.join(tied, "root").select("cls", "component_id")
    return rows.select("id", "cls", "n").join(named, "cls", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def _flips(a: str, b: str) -> Column:
    """Bits that differ between two sketches."""
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _texts_of(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Full sets of the wanted classes, from the text of one row of each.

    Ids may be repeated or null, so the set made from a row counts for the class that its own digest names.
    """
    ids = wanted.select(F.col("id").alias("__id")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("t"))
    named = texts.join(ids, texts["__id"].eqNullSafe(ids["__id"]), "left_semi").select("t")
    return (shingle_sets(named, size).join(wanted.select("cls"), "cls", "left_semi")
            .groupBy("cls").agg(F.first("set").alias("set")))
