"""SimHash near-duplicates: fingerprints are cut into blocks, pairs are joined on shared blocks, then verified.

Two fingerprints that differ in at most ``most`` bits agree in at least ``blocks - most`` of ``blocks`` blocks, so they
share the value of some choice of that many blocks: rows are joined on each choice. More blocks make longer keys and so
smaller buckets; their number grows with the number of different fingerprints, and any number finds all links.

Equal fingerprints are one node. In a bucket of up to ``SMALL`` nodes all pairs are compared, by a join on the bucket.
The nodes of larger buckets are linked without their pairs: two fingerprints differ in at most 2r bits if and only if
some value lies within r bits of both. Each such node lists the values near it, and the nodes that list a value are
tied to the smallest of them, which joins exactly the components that the links join (for an odd number of bits, one
of the two lies one bit further off).
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from stillwave.llm.common import connected, join_by_measure, stash

BITS = 64
#: Buckets of up to so many fingerprints are compared pair by pair.
SMALL = 48
#: Bits that a key has beyond the logarithm of the number of fingerprints.
SPARE = 3
#: Bytes of a text, and shingles of it, that are worked on at once.
SLICE, SHINGLES = 1 << 21, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(text: bytes):
    """The words of a text, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash over the ``size``-word shingles: a bit is set if it is in more than half of their hashes."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []
    seed = xxhash.xxh64_intdigest

    def add(joined: bytes, lengths: np.ndarray, count: int):
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = ends[:count] - lengths[:count], ends[size - 1:size - 1 + count]
        for i in range(0, count, SHINGLES):
            hashes = [seed(joined[a:b], 42) for a, b in zip(starts[i:i + SHINGLES].tolist(), ends[i:i + SHINGLES].tolist())]
            ones.__iadd__(np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(
                axis=0, dtype=np.int64))

    for words in words_of(text):
        words = last + words
        count = len(words) - size + 1
        if count > 0:
            add(b" ".join(words), np.fromiter(map(len, words), np.int64, len(words)), count)
            total += count
            last = words[count:]
        else:
            last = words
    if not total and last:  # fewer words than a shingle has
        return seed(b" ".join(last), 42)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, fp) of each row, the fingerprint as a signed long; 0 without words."""
    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), size) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])

    return (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
            .mapInArrow(run, "id long, fp long"))


def distance(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def choices(most: int, n: int) -> list[int]:
    """Bit masks of which any two values that differ in ``most`` bits or fewer agree under at least one.

    The fewest blocks whose choices have ``log2(n) + SPARE`` bits, or 4 blocks more than ``most``.
    """
    for blocks in range(most + 1, most + 5):
        kept = blocks - most
        if BITS * kept / blocks >= log2(max(n, 2)) + SPARE:
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, kept)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_values(of: DataFrame, radius: int, inner: int) -> DataFrame:
    """(fp, value, inner) for each value at most ``radius`` bits from ``fp``, and whether it is at most ``inner`` off."""
    flips = [(signed(sum(1 << i for i in bits)), r <= inner)
             for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    flip, within = np.array([f for f, _ in flips], np.int64), np.array([w for _, w in flips])

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 100):
                part = fp[at:at + 100]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part, len(flip))), pa.array((part[:, None] ^ flip).ravel()),
                     pa.array(np.tile(within, len(part)))], names=["fp", "value", "inner"])

    return of.select("fp").mapInArrow(run, "fp long, value long, inner boolean")


def links(nodes: DataFrame, most: int, n: int) -> DataFrame:
    """Edges (a, b) between fingerprints ``fp``, whose components are those of all pairs at most ``most`` bits apart."""
    masks = choices(most, n)
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("part", "key")
    spread = nodes.select("fp", keys)
    sizes = spread.groupBy("part", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = stash(spread.join(sizes, ["part", "key"]))
    few = members.where(F.col("m") <= SMALL)
    one, two = (few.select("part", "key", F.col("fp").alias(c)) for c in "ab")
    pairs = one.join(two, ["part", "key"]).where("a < b").where(distance("a", "b") <= most).select("a", "b").distinct()

    # Nodes of large buckets meet in the values between them. Those within the inner radius of a value are all linked
    # to each other and to the rest; a value has at most as many nodes as there are values around it.
    crowd = members.where(F.col("m") > SMALL).select("fp").distinct()
    meet = Window.partitionBy("value")
    tied = (near_values(crowd, most - most // 2, most // 2)
            .withColumn("a", F.min(F.when(F.col("inner"), F.col("fp"))).over(meet))
            .where("a <> fp").select("a", F.col("fp").alias("b")).distinct())
    return pairs.union(tied)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4,
                    most: int = 4) -> DataFrame:
    """Per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints are SimHashes over all ``size``-word shingles, repeats included, of the words between ASCII white
    space with A-Z in lower case (fewer words are one shingle); a shingle's hash is XXH64 with seed 42 of its words
    joined by blanks. Two rows are linked if their fingerprints differ in at most ``most`` bits (at most 6: the values
    between two fingerprints grow fast). ``component_id`` is the smallest id that links reach, the row's own included.

    A null or wordless text has fingerprint zero and is linked like any other. Rows that share an id are rows of their
    own with that id; a null id is never the smallest, and a component without ids has none. Equal fingerprints are
    one node, so groups of copies cost one. Texts of any length are read in slices. Other columns are not looked at.
    An empty table gives an empty one.
    """
    if not 0 <= most <= 6:
        raise ValueError("most must be from 0 to 6")
    join_by_measure(docs.sparkSession)
    rows = stash(fingerprints(docs, doc_id, text, size))
    nodes = stash(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(links(nodes, most, nodes.count()))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    low = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(low, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
