"""Episodes: from flags to intervals and back, merging, correcting, scoring.

An episode row is ``(subject, counter, start_index, stop_index, start, stop,
label)``. ``stop_index`` is the last index of the run; marking an episode on a
signal covers ``[start_index, stop_index)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stillwave.operators.chunked import DEFAULT_SIZE, attach_row, div, merge_runs, row_index

SUBJECT = ("subject",)


def number_episodes(episodes: DataFrame, keys: Sequence[str] = SUBJECT, start: str = "start_index",
                    size: int = DEFAULT_SIZE, name: str = "counter") -> DataFrame:
    """Ordinal per subject in time order, from 0."""
    return row_index(episodes, keys, [start], div(start, size), name)


def to_episodes(
    flags: DataFrame, condition: Column, idx: str = "idx", ts: str | None = "ts",
    keys: Sequence[str] = SUBJECT, increment: int = 1, size: int = DEFAULT_SIZE, counter: bool = True,
) -> DataFrame:
    """Runs of consecutive rows that satisfy ``condition``."""
    rows = flags.filter(condition).select(
        *keys, F.col(idx).alias("start_index"), F.col(idx).alias("stop_index"),
        *([F.col(ts).alias("_ts")] if ts else []))
    aggs = {"start": ("first", "_ts"), "stop": ("last", "_ts")} if ts else {}
    runs = merge_runs(rows, keys, "start_index", "stop_index", size, max_gap=increment,
                      exact_gap=increment != 1, aggs=aggs)
    return number_episodes(runs, keys, size=size) if counter else runs


def run_table(
    df: DataFrame, value: str, idx: str = "idx", keys: Sequence[str] = SUBJECT, size: int = DEFAULT_SIZE,
) -> DataFrame:
    """Run-length encoding of ``value``: ``(keys, value, start_index, stop_index)``."""
    rows = df.select(*keys, value, F.col(idx).alias("start_index"), F.col(idx).alias("stop_index"))
    return merge_runs(rows, keys, "start_index", "stop_index", size, same=[value])


def mark_episodes(
    samples: DataFrame, episodes: DataFrame, idx: str = "idx", start: str = "start_index",
    stop: str = "stop_index", keys: Sequence[str] = SUBJECT, block_rows: int = 4096, name: str = "marked",
) -> DataFrame:
    """Add 1 where a sample lies in ``[start, stop)`` of any episode, else 0.

    Episodes are cut at block borders, so both sides meet in an equi-join on
    (subject, block) and a long episode is spread over many tasks. Pieces of
    overlapping episodes that cover the same part of a block collapse.
    """
    cut = (
        episodes.filter(F.col(stop) > F.col(start))
        .select(*keys, F.col(start).alias("_a"), F.col(stop).alias("_b"),
                F.explode(F.sequence(div(start, block_rows), div(F.col(stop) - 1, block_rows))).alias("_block"))
        .select(*keys, "_block",
                F.struct(F.greatest("_a", F.col("_block") * block_rows).alias("a"),
                         F.least("_b", (F.col("_block") + 1) * block_rows).alias("b")).alias("_piece"))
        .groupBy(*keys, "_block").agg(F.collect_set("_piece").alias("_pieces"))
    )
    joined = samples.withColumn("_block", div(idx, block_rows)).join(cut, [*keys, "_block"], "left")
    hit = F.exists("_pieces", lambda p: (F.col(idx) >= p["a"]) & (F.col(idx) < p["b"]))
    return joined.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int")).drop("_block", "_pieces")


def group_near(
    episodes: DataFrame, distance_mins: int = 3, correction: int = 3, hz: int = 100,
    keys: Sequence[str] = SUBJECT, size: int | None = None, samples_per_min: int | None = None,
) -> DataFrame:
    """Merge episodes at most ``distance`` minutes (plus a correction) apart.

    The merged row keeps the first label; its counter reads ``first-last``
    when it stands for several episodes.
    """
    per_min = samples_per_min or hz * 60
    limit = per_min * distance_mins + correction
    columns = set(episodes.columns)
    aggs = {"_first": ("first", "counter"), "_last": ("last", "counter")}
    if "label" in columns:
        aggs["label"] = ("first", "label")
    if {"start", "stop"} <= columns:
        aggs |= {"start": ("first", "start"), "stop": ("last", "stop")}
    merged = merge_runs(episodes, keys, "start_index", "stop_index", size or max(DEFAULT_SIZE, 8 * limit),
                        max_gap=limit, aggs=aggs)
    name = F.when(F.col("_first") == F.col("_last"), F.col("_first").cast("string")).otherwise(
        F.concat_ws("-", F.col("_first").cast("string"), F.col("_last").cast("string")))
    return merged.withColumn("counter", name).drop("_first", "_last")


def merge_training_episodes(
    episodes: DataFrame, manual: DataFrame, distance_mins: int = 3, correction: int = 3, hz: int = 100,
    samples_per_min: int | None = None,
) -> DataFrame:
    """Training labels: listed merges, other non-wear as is, wear episodes grouped.

    ``manual`` is ``(subject, first_counter, last_counter)``.
    """
    columns = ["subject", "counter", "start_index", "stop_index", "label"]
    lookup = manual.select("subject", "first_counter", "last_counter")
    tagged = episodes.join(lookup, "subject", "left")
    within = F.col("counter").between(F.col("first_counter"), F.col("last_counter"))
    listed = (
        tagged.filter((F.col("counter") == F.col("first_counter")) | (F.col("counter") == F.col("last_counter")))
        .groupBy("subject", "first_counter", "last_counter").agg(
            F.min_by("start_index", "counter").alias("start_index"),
            F.max_by("stop_index", "counter").alias("stop_index"),
            F.min_by("label", "counter").alias("label"))
        .withColumn("counter", F.concat_ws("-", F.col("first_counter").cast("string"), F.col("last_counter").cast("string")))
    )
    kept = tagged.filter((F.col("label") == 0) & ~F.coalesce(within, F.lit(False))).withColumn(
        "counter", F.col("counter").cast("string"))
    wear = group_near(episodes.filter("label = 1").select(*columns), distance_mins, correction, hz,
                      samples_per_min=samples_per_min)
    return (
        listed.select(*columns, F.lit("listed").alias("source"))
        .unionByName(kept.select(*columns, F.lit("kept").alias("source")))
        .unionByName(wear.select(*columns, F.lit("grouped").alias("source")))
    )


def correct_labels(episodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Flip the label of listed ``(subject, counter)`` pairs."""
    marked = corrections.select("subject", "counter", F.lit(True).alias("_hit")).distinct()
    return (
        episodes.join(marked, ["subject", "counter"], "left")
        .withColumn("label", F.when(F.col("_hit"), 1 - F.col("label")).otherwise(F.col("label"))).drop("_hit")
    )


def union_intervals(intervals: DataFrame, keys: Sequence[str] = SUBJECT, start: str = "start", stop: str = "stop",
                    block_rows: int = 4096, size: int = DEFAULT_SIZE) -> DataFrame:
    """Union of any ``[start, stop)`` ranges per key, as disjoint ranges.

    Ranges are cut at block borders; inside a block they are merged by the
    furthest stop so far, and whole blocks are merged as runs.
    """
    pieces = (
        intervals.filter(F.col(stop) > F.col(start))
        .select(*keys, F.col(start).alias("_a"), F.col(stop).alias("_b"),
                F.explode(F.sequence(div(start, block_rows), div(F.col(stop) - 1, block_rows))).alias("_block"))
        .select(*keys, "_block", F.greatest("_a", F.col("_block") * block_rows).alias("_a"),
                F.least("_b", (F.col("_block") + 1) * block_rows).alias("_b"))
        .groupBy(*keys, "_block", "_a").agg(F.max("_b").alias("_b"))
    )
    along = W.partitionBy(*keys, "_block").orderBy("_a")
    reach = F.max("_b").over(along.rowsBetween(W.unboundedPreceding, -1))
    pieces = pieces.select("*", F.coalesce(F.col("_a") > reach, F.lit(True)).cast("long").alias("_new"))
    pieces = pieces.select("*", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("_g"))
    merged = pieces.groupBy(*keys, "_block", "_g").agg(F.min("_a").alias(start), F.max("_b").alias(stop))
    return merge_runs(merged, keys, start, stop, size, max_gap=0)


def overlap_confusion(predicted: DataFrame, truth: DataFrame, totals: DataFrame, block_rows: int = 4096,
                      keys: Sequence[str] = SUBJECT, truth_keys: Sequence[str] | None = None) -> DataFrame:
    """Confusion counts from intervals instead of samples.

    ``predicted`` and ``truth`` hold disjoint ``[start, stop)`` per key, ``totals`` the
    number ``n`` of samples. Both sides are cut into blocks, so the overlap
    join is an equi-join whose groups are bounded by the block length. With
    ``truth_keys``, some of ``keys``, the truth is the same for all values of
    the others and isn't repeated for them.
    """
    shared = list(truth_keys or keys)

    def cut(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
        return (
            df.filter(F.col("stop") > F.col("start"))
            .select(*keys, "start", "stop",
                    F.explode(F.sequence(div("start", block_rows), div(F.col("stop") - 1, block_rows))).alias("_block"))
            .select(*keys, "_block", F.greatest("start", F.col("_block") * block_rows).alias(a),
                    F.least("stop", (F.col("_block") + 1) * block_rows).alias(b))
        )

    hits = (
        cut(predicted, "_pa", "_pb", keys).join(cut(truth, "_ta", "_tb", shared), [*shared, "_block"])
        .filter((F.col("_pa") < F.col("_tb")) & (F.col("_ta") < F.col("_pb")))
        .groupBy(*keys).agg(F.sum(F.least("_pb", "_tb") - F.greatest("_pa", "_ta")).alias("tp"))
    )
    size = lambda df, name, keys: df.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias(name))
    joined = (
        totals.join(hits, list(keys), "left").join(size(predicted, "_p", keys), list(keys), "left")
        .join(size(truth, "_t", shared), shared, "left").na.fill(0, ["tp", "_p", "_t"])
    )
    return joined.select(
        *keys, (F.col("n") - F.col("_p") - F.col("_t") + F.col("tp")).alias("tn"),
        (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"), "tp")


def durations(episodes: DataFrame, unit_rows: int) -> DataFrame:
    """Whole units (for instance minutes) per episode."""
    return episodes.withColumn("length", div(F.col("stop_index") - F.col("start_index") + 1, unit_rows))


def length_overview(lengths: DataFrame, recorded_units: DataFrame, split: int = 60) -> DataFrame:
    """Count, mean, population SD, total and share of episodes: all, shorter, longer."""
    group = F.explode(F.array(F.lit("all"), F.when(F.col("length") < split, "shorter").otherwise("longer")))
    stats = lengths.select("length", group.alias("grp")).groupBy("grp").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("length").alias("mean_length"),
        F.stddev_pop("length").alias("sd_length"), F.sum("length").alias("total_length"))
    total = recorded_units.agg(F.sum("units").alias("recorded"))
    everything = stats.filter("grp = 'all'").agg(F.max("episodes").alias("_all"))
    return (
        attach_row(attach_row(stats, total), everything)
        .select("grp", "episodes", "mean_length", "sd_length", "total_length", "recorded",
                (F.col("total_length") / F.col("recorded") * 100).alias("share_of_time"),
                (F.col("episodes") / F.col("_all") * 100).alias("share_of_episodes"))
    )


def hour_distribution(minutes: DataFrame, truth: str = "truth", ts: str = "ts", split: int = 59) -> DataFrame:
    """Subjects with non-wear per hour of day: any, up to ``split`` minutes, more; with shares.

    One row for each of the 24 hours, also for hours without non-wear.
    """
    per_subject = minutes.groupBy("subject", F.hour(ts).alias("hour")).agg(F.sum(truth).alias("_m"))
    counted = per_subject.groupBy("hour").agg(
        F.count_if(F.col("_m") > 0).alias("any_nw"),
        F.count_if((F.col("_m") > 0) & (F.col("_m") <= split)).alias("short_nw"),
        F.count_if(F.col("_m") > split).alias("long_nw"))
    hours = minutes.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    filled = hours.join(counted, "hour", "left").na.fill(0)
    totals = filled.agg(*[F.sum(c).alias(f"_t_{c}") for c in ("any_nw", "short_nw", "long_nw")])
    return attach_row(filled, totals).select(
        "hour", "any_nw", "short_nw", "long_nw",
        *[F.try_divide(F.col(c), F.col(f"_t_{c}")).alias(c.replace("_nw", "_share")) for c in ("any_nw", "short_nw", "long_nw")])
