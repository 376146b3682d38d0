"""Licence scan by canonical digest lookup. DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines gone, one spelling of variants, letters and digits
only. The digest of the whole canonical text is looked up among those of known licences by a hash join; so is the
digest of each of its lines, since a notice is a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stillwave.llm.licence_texts import LICENCES, SPELLINGS

#: A line that says who holds the rights, and what is neither letter, digit nor line end.
HOLDER = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright (?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}\n]+"
#: Most known texts: the table is broadcast.
MOST_KNOWN = 100_000


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line that has any letter or digit."""
    form = F.regexp_replace(F.lower(text), HOLDER, "")
    for variant, canonical in SPELLINGS:
        form = F.replace(form, F.lit(variant), F.lit(canonical))
    lines = F.split(F.regexp_replace(form, OTHER, " "), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


def _digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_digests(known: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(digest, license) of known texts; of names with one digest the first."""
    whole = F.array_join(canonical_lines(F.col(text)), " ")
    return (known.select(F.col(name).alias("license"), whole.alias("form")).where("form <> ''")
            .groupBy(_digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``license`` (of the entire text, or null), ``notices`` (licences of single lines), ``n_notices``.

    ``notices`` lists the names in order, comma-joined and each once, ``n_notices`` counts the lines. ``known`` is a
    table (name, text), by default ``LICENCES``; more than ``MOST_KNOWN`` texts are refused. A null, empty or wordless
    text is no licence. Rows with equal id and text have equal results. Other columns are not looked at. Only ids,
    text hashes and matching lines are shuffled.
    """
    spark = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(list(LICENCES), "name string, text string")
    digests = known_digests(known)
    if digests.limit(MOST_KNOWN + 1).count() > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select(
        "id", F.xxhash64("t").alias("th"), canonical_lines(F.col("t")).alias("lines"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("entire"), _digest(F.array_join("lines", " ")).alias("digest"))),
                     F.transform("lines", lambda s: F.struct(F.lit(False).alias("entire"), _digest(s).alias("digest"))))
    # Rows with equal id and text are told from each other no further, so each line counts once by its place.
    found = (rows.select("id", "th", F.posexplode(units).alias("place", "u")).select("id", "th", "place", "u.*")
             .join(F.broadcast(digests), "digest").groupBy("id", "th").agg(
                 F.max(F.when(F.col("entire"), F.col("license"))).alias("license"),
                 F.array_join(F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("license")))), ",").alias("notices"),
                 F.count_distinct(F.when(~F.col("entire"), F.col("place"))).alias("n_notices"))
             .withColumnsRenamed({"id": "xid", "th": "xth"}))
    ids = docs.select(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    return ids.join(found, F.col(doc_id).eqNullSafe(F.col("xid")) & (F.col("th") == F.col("xth")), "left").select(
        doc_id, "license", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
