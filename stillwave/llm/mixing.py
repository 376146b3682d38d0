"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are added up by membership pattern, the set of sources they belong to. Each pattern offers its tokens once at
no cost, a second time at cost 1, a third at cost 2 and so on, so repeating is spread before it is deepened; each source
asks for its quota. The cheapest flow from patterns to sources says how many tokens each pattern gives. Inside a pattern
a seeded order of its documents then decides which of them give one repetition more.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from stillwave.llm.common import WORD, cut, stash

#: Hex digits of the seeded order looked at in a step: a step splits a group of documents into 16 ** DIGITS cells.
DIGITS = 3
#: Documents that a cell may hold before the order inside it is settled row by row.
CELL_ROWS = 4096
#: A mix of more patterns than this is refused: the flow is solved by the driver.
MOST_PATTERNS = 200_000


def water_fill(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = total - most * sum(sizes[i] for i in range(len(sizes)) if i not in set(open_))
        weight = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = weights[i] * left / weight
        over = {i for i in open_ if targets[i] > most * sizes[i]}
        if not over:
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in over]
    return targets


def min_cost_flow(supply: list[int], edges: list[tuple[int, int]], demand: list[int], repeats: int) -> dict[tuple[int, int], int]:
    """Tokens from pattern p to source s for (p, s) in ``edges``.

    Pattern p gives up to ``supply[p]`` tokens in each of ``repeats`` rounds at costs 0, 1, 2, ...; source s takes up to
    ``demand[s]``. The largest flow of the least cost, by shortest augmenting paths with potentials.
    """
    n_p, n_s = len(supply), len(demand)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]  # [to, room, cost, index of the way back]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, tokens in enumerate(supply):
        for cost in range(repeats):
            arc(start, p, tokens, cost)
    places = {}
    for p, s in edges:
        places[p, s] = (p, len(graph[p]))
        arc(p, n_p + s, repeats * supply[p], 0)
    for s, tokens in enumerate(demand):
        arc(n_p + s, end, tokens, 0)
    height = [0] * (end + 1)
    while True:
        far, via = [float("inf")] * (end + 1), [None] * (end + 1)
        far[start], queue = 0, [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (to := d + cost + height[a] - height[b]) < far[b]:
                    far[b], via[b] = to, (a, k)
                    heapq.heappush(queue, (to, b))
        if via[end] is None:
            taken = {}
            for edge, (p, k) in places.items():
                to, _, _, back = graph[p][k]
                taken[edge] = graph[to][back][1]  # what could flow back has flowed
            return taken
        reach = max(d for d in far if d < float("inf"))
        height = [h + min(d, reach) for h, d in zip(height, far)]
        room, b = float("inf"), end
        while b != start:
            a, k = via[b]
            room, b = min(room, graph[a][k][1]), a
        b = end
        while b != start:
            a, k = via[b]
            graph[a][k][1] -= room
            graph[b][graph[a][k][3]][1] += room
            b = a


def _settle(docs: DataFrame, given: DataFrame) -> DataFrame:
    """``docs`` (pattern, size, spot, ...) with ``taken`` words: ``given`` has pattern, whole (full repetitions) and rest.

    In the seeded order of a pattern's documents the first ones give ``rest`` words more, the last of them only a part.
    The place where the rest runs out is found by adding up cells of the order, step by step inside the cell where it
    runs out; a step's result is at most 16 ** DIGITS rows a pattern. No window spans a pattern's documents. ``given`` and the places hold one row a pattern, at
    most ``MOST_PATTERNS``, and are broadcast, so that a pattern with most documents is no hot key.
    """
    border = given.select("pattern", F.lit("").alias("cell"), "rest")
    depth = 0
    while True:
        inside = docs.join(F.broadcast(border), "pattern").where(F.col("spot").startswith(F.col("cell")))
        if depth == 30:  # nearly all of the 32 digits: what is left there has one id
            break
        cells = (inside.groupBy("pattern", "rest", F.substring("spot", 1, depth + DIGITS).alias("next"))
                 .agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
        order = Window.partitionBy("pattern").orderBy("next")
        ends = F.sum("words").over(order)
        crossed = cut(cells.withColumn("end", ends).where((F.col("end") > F.col("rest"))
                                                          & (F.col("end") - F.col("words") <= F.col("rest")))
                      .groupBy("pattern").agg(F.min(F.struct(
                          F.col("next").alias("cell"), (F.col("rest") - F.col("end") + F.col("words")).alias("rest"),
                          "rows")).alias("c"))
                      .select("pattern", "c.*"))
        largest = crossed.agg(F.max("rows")).first()[0] or 0
        border, depth = crossed.select("pattern", "cell", "rest"), depth + DIGITS
        if largest <= CELL_ROWS:
            break
    # In the last cell, row by row; before it everything, after it nothing.
    order = Window.partitionBy("pattern").orderBy("spot", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (docs.join(F.broadcast(given.select("pattern", "whole")), "pattern", "left").join(
        F.broadcast(border.withColumnRenamed("rest", "rest_here")), "pattern", "left"))
    at = F.substring("spot", 1, F.length("cell"))
    before = joined.where(F.col("cell").isNull() | (at != F.col("cell"))).withColumn(
        "more", F.when(at < F.col("cell"), F.col("size")).otherwise(F.lit(0)))
    here = joined.where(at == F.col("cell")).withColumn("end", F.sum("size").over(order)).withColumn(
        "more", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest_here") - F.col("end") + F.col("size"))))
    return (before.unionByName(here.drop("end"))
            .withColumn("taken", F.coalesce("whole", F.lit(0)) * F.col("size") + F.col("more"))
            .drop("whole", "more", "cell", "rest_here"))


def mix(docs: DataFrame, targets: dict[str, int], sources: Column, size: Column, doc_id: str = "doc_id",
        repeats: int = 3, seed: int = 1) -> tuple[DataFrame, dict]:
    """Words each document gives to a mix, and the tokens that flow from patterns to sources.

    ``sources`` is an array of the names of the sources a row belongs to (repeated names count once), ``size`` its words,
    ``targets`` the words each source is to give. Returns ``docs`` with ``pattern``, ``size`` and ``taken`` (columns of
    these names are replaced), and {(pattern, source): tokens}. A row gives at most ``repeats`` times its size; if
    quotas can't all be met, the largest flow is taken. Rows without a wanted source, or without words, give nothing.
    Rows that share an id are ordered by size, so reruns agree. The order is md5 of seed and id.
    """
    spark = docs.sparkSession
    rows = stash(docs.withColumns({"pattern": F.array_sort(F.array_distinct(sources)), "size": size.cast("long"),
                                   "spot": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")))}))
    patterns = rows.groupBy("pattern").agg(F.sum("size").alias("words")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"the sources overlap in more than {MOST_PATTERNS} patterns")
    names = sorted(targets)
    place = {name: i for i, name in enumerate(names)}
    edges = [(p, place[name]) for p, row in enumerate(patterns) for name in row["pattern"] or [] if name in place]
    supply = [row["words"] or 0 for row in patterns]
    flow = min_cost_flow(supply, edges, [targets[name] for name in names], repeats)
    out = [0] * len(patterns)
    for (p, _), tokens in flow.items():
        out[p] += tokens
    kind = T.StructType([rows.schema["pattern"], T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    given = spark.createDataFrame([(row["pattern"], tokens // words, tokens % words) for row, words, tokens
                                   in zip(patterns, supply, out) if words], kind)
    routes = {(tuple(patterns[p]["pattern"]), names[s]): tokens for (p, s), tokens in flow.items()}
    return _settle(rows, given).drop("spot"), routes


def word_count(text: str) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def weighted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 1) -> DataFrame:
    """Mix single sources by repeating ``weights`` in the order of their names by code point, null last.

    Returns per row the id, ``size``, ``source_size``, ``target`` and ``taken``. The targets share the size of all
    documents; none is above ``repeats`` times its source (``water_fill``). A null source is a source of its own.
    A null text has size 0. An empty table gives an empty result.
    """
    # Names that sort as the sources do, with null last.
    name = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    rows = stash(docs.select(F.col(doc_id), name.alias("name"), word_count(text).alias("size")))
    sums = rows.groupBy("name").agg(F.sum("size").alias("n")).orderBy("name").limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sources")
    sizes = [r["n"] for r in sums]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeats)
    quotas = {r["name"]: int(t + 0.5) for r, t in zip(sums, targets)}
    mixed, _ = mix(rows, quotas, F.array("name"), F.col("size"), doc_id, repeats, seed)
    facts = docs.sparkSession.createDataFrame([(r["name"], r["n"], t) for r, t in zip(sums, targets)],
                                              "name string, source_size long, target double")
    return mixed.join(F.broadcast(facts), "name").select(doc_id, "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix has them: a row comes once for each whole time it is taken, and once more for half a time."""
    taken = weighted(docs, doc_id, text, source, **how).groupBy(F.col(doc_id).alias("__id")).agg(
        F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).alias("__times"))
    joined = docs.join(taken, F.col(doc_id).eqNullSafe(F.col("__id")))
    return (joined.withColumn("__copy", F.explode(F.when(F.col("__times") > 0, F.sequence(F.lit(1), F.col("__times").cast("int")))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
