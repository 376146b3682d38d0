"""SpotSigs fingerprints: chains of content words that follow common words. DataFrame and SQL functions only.

A common word is an anchor; with the next content words it makes a signature. Boilerplate has few anchors, prose has
many, so the set of signatures follows the prose. Two sets are compared by Jaccard similarity; sets whose lengths rule
out a similarity are not compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Common function words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this",
    "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "au", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y",
)
#: Content words of a chain, and the words after an anchor among which they are looked for.
CHAIN, WINDOW = 2, 8
#: Most parts that the order of ids is cut into, the rows of one at least, and bounds compared in a step.
MOST_CHUNKS, CHUNK_ROWS, STEP = 4096, 500, 64


def signatures(text: str) -> Column:
    """Sorted distinct 40-bit hashes of the chains of a text, given as SQL.

    Words are runs of letters and digits, lower-cased. A text without a whole chain has one signature of all its words,
    one without words has one of the text itself; a null or empty text has none.
    """
    common = ", ".join(f"'{w}'" for w in ANCHORS)
    chain = f"slice(filter(slice(w, i + 2, {WINDOW}), y -> y NOT IN ({common})), 1, {CHAIN})"
    # An array of one element gives a value a name that later steps use without computing it again.
    return F.expr(f"""
        transform(array(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x != '')), w ->
        transform(array(filter(transform(w, (x, i) -> CASE WHEN x IN ({common}) THEN
            transform(array({chain}), c -> CASE WHEN size(c) = {CHAIN} THEN shiftrightunsigned(xxhash64(x, c), 24) END)[0]
            END), s -> s IS NOT NULL)), s -> CASE WHEN size(s) > 0 THEN array_sort(array_distinct(s))
                WHEN size(w) > 0 THEN array(shiftrightunsigned(xxhash64(w), 24))
                WHEN length({text}) > 0 THEN array(shiftrightunsigned(xxhash64({text}), 24))
                ELSE cast(array() AS array<bigint>) END)[0])[0]""")


def fingerprint(sigs: Column) -> Column:
    """The set as text: hexadecimal, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike, an empty one and another are not."""
    common = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(common / (F.size(a) + F.size(b) - common)))


def _chunk(doc_id: str, bounds: list) -> Column:
    """How many of the sorted bounds an id reaches, in two steps; a null id comes before all."""
    kind = "array<bigint>"
    every = F.array(*[F.lit(b) for b in bounds]).cast(kind)
    steps = F.array(*[F.lit(b) for b in bounds[STEP - 1::STEP]]).cast(kind)
    full = F.size(F.filter(steps, lambda b: b <= F.col(doc_id))) * STEP
    rest = F.size(F.filter(F.slice(every, full + 1, STEP), lambda b: b <= F.col(doc_id)))
    return F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(full + rest).cast("int")


def with_next(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """Rows (id, t, th, g, ctx) and a window over them in which the next row is the next document by descending id.

    Ids are cut into at most ``MOST_CHUNKS`` ranges at their quantiles, so no window holds the table. The first
    document of a range is also put at the end of the range before it (``ctx`` 1); the first of all follows the last.
    Rows that share an id are ordered by their text's hash; rows without one come last.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    n = ids.count()
    m = min(MOST_CHUNKS, max(1, n // CHUNK_ROWS))
    cuts = ids.agg(F.percentile_approx("id", [k / m for k in range(1, m)] or [0.5], 20 * m + 100)).first()[0] or []
    chunk = _chunk("id", sorted(set(cuts)))
    # One row a range, so bounded by MOST_CHUNKS.
    tops = sorted(ids.groupBy(chunk.alias("chunk")).agg(F.max("id").alias("top")).collect())
    to = [(tops[i]["chunk"], tops[i]["top"], tops[(i + 1) % len(tops)]["chunk"]) for i in range(len(tops))]
    places = docs.sparkSession.createDataFrame(to, "chunk int, top long, before int")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumns({"th": F.xxhash64("t"), "chunk": chunk}).join(F.broadcast(places), "chunk")
    here, before = F.struct(F.col("chunk").alias("g"), F.lit(0).alias("ctx")), F.struct(F.col("before").alias("g"), F.lit(1).alias("ctx"))
    rows = rows.select("id", "t", "th", F.explode(F.when(F.col("id").eqNullSafe(F.col("top")), F.array(here, before))
                                                  .otherwise(F.array(here))).alias("p")).select("id", "t", "th", "p.*")
    return rows, Window.partitionBy("g").orderBy("ctx", F.desc_nulls_last("id"), "th")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: fingerprint of the text and of an edited text, whose second half is the start of the next document.

    Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. A null text counts as empty. Other columns are not looked at. An empty table gives an empty result.
    The texts are shuffled once, to ranges of ids.
    """
    rows, order = with_next(docs, doc_id, text)
    half = F.floor(F.length("t") / 2).cast("int")
    rows = (rows.withColumn("next", F.coalesce(F.lead("t").over(order), F.lit("")))
            .withColumn("edited", F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 2) AS int))"),
                                           F.substring(F.col("next"), F.lit(1), half)))
            .select("id", "th", "g", "ctx", F.length("t").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    signatures("t").alias("sigs"), F.when(F.col("ctx") == 0, signatures("edited")).alias("edited_sigs")))
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(order)).where("ctx = 0")
    return rows.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
                       fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                       likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                       likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def similar(queries: DataFrame, docs: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, likeness) of all documents as like a query as ``threshold`` (above 0), for a stated query set.

    Sets are partitioned by length: a length and those up to 1 / threshold times as long share a partition or
    neighbour one. In a partition, a pair must share one of the first n - ceil(threshold n) + 1 signatures of both sets
    in hash order; only such pairs are compared in full.
    """
    def posted(rows: DataFrame, id_name: str, sigs: str) -> DataFrame:
        base = rows.select(F.col(doc_id).alias(id_name), signatures(f"coalesce(`{text}`, '')").alias(sigs)).where(F.size(sigs) > 0)
        n = F.size(sigs)
        return base.withColumn("part", F.floor(F.log(n.cast("double")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else n
                               ).withColumn("sig", F.explode(F.slice(F.col(sigs), F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))))

    asked = posted(queries, "query_id", "qs").withColumn("part", F.explode(F.array(*[F.col("part") + i for i in (-1, 0, 1)])))
    pairs = asked.join(posted(docs, "__doc", "ds"), ["part", "sig"]).where(
        (F.size("qs") >= threshold * F.size("ds")) & (F.size("ds") >= threshold * F.size("qs")))
    near = pairs.select("query_id", "__doc", likeness(F.col("qs"), F.col("ds")).alias("likeness"))
    return near.where(F.col("likeness") >= threshold).distinct().withColumnRenamed("__doc", doc_id)
