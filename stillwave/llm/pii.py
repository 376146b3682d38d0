"""Personal data: fixed patterns seed a bootstrapped contextual extraction. DataFrame and SQL functions only.

Matches of four fixed patterns are the seed entities. The words around them are lexical patterns. Tokens with a digit or
an at sign that no seed covers are candidate instances. Patterns and instances form a graph: a pattern is as trusted as
the share of its instances that are trusted, an instance as its patterns together. A few rounds of two joins score the
graph; instances that trusted patterns agree on are identifiers, wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stillwave.llm.common import cut, stash

#: Kinds in the order that results list them, and the form of each. Each form finds the leftmost
#: non-overlapping matches in time that grows with the text: a match starts where a run starts or a match ended, and
#: runs give nothing back.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a form to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A token with a digit or at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A pattern counts from this weight of trusted instances on, and from this share of its instances on.
SUPPORT, TRUST = 3.0, 0.6
#: An instance is accepted from this score on, with this many patterns behind it.
ACCEPT, PATTERNS = 0.95, 2
#: What an instance of a kind looks like at least, whatever its context: an at sign; three groups with points or colons
#: between them; the digits of a card; seven digits. Contexts alone would also catch ordinary words with a digit.
LOOKS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9a-f]*[0-9][0-9a-f]*(?:[.:][0-9a-f]*){2,7}$",
    "card": r"^[0-9](?:-?[0-9]){11,18}$",
    "phone": r"^\+?\(?[0-9](?:[().-]*[0-9]){6,14}$",
}
#: Rounds of scoring.
ROUNDS = 3
#: Lengths are added up in blocks of so many, so that a text with very many matches takes no quadratic time.
BLOCK = 256
#: Characters of the text around a match that its context is taken from, and code points of a part of a text.
AROUND, PART = 64, 4096


def _octets() -> str:
    octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return rf"^{octet}(?:\.{octet}){{3}}$"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    one = f"cast(substring(reverse({digits}), i, 1) AS int)"
    return (f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {one} "
            f"WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END) % 10 = 0")


def _valid(kind: str, value: str) -> str:
    """SQL: whether a match of the form is one of the kind."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"{value} RLIKE r'{_octets()}'",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {_luhn(digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]


def _matches(text: str, form: str) -> Column:
    """All matches: array of (start, end, value, left, right) in code points, with the text around each.

    The text between matches comes from a split by the same form; starts are running sums of both lengths.
    """
    hits, gaps = f"regexp_extract_all({text}, r'{form}', 0)", f"split({text}, r'{form}', -1)"
    return F.expr(f"""
        transform(array(struct({hits} AS hits, {gaps} AS gaps)), m -> transform(array(struct(m.hits AS hits, m.gaps AS gaps,
            transform(sequence(0, greatest(size(m.hits) - 1, 0) div {BLOCK}), b -> slice(zip_with(m.hits,
                slice(m.gaps, 1, size(m.hits)), (h, g) -> length(h) + length(g)), b * {BLOCK} + 1, {BLOCK})) AS blocks)),
        n -> transform(array(aggregate(n.blocks, struct(0 AS at, cast(array() AS array<int>) AS offsets),
                (s, b) -> struct(s.at + aggregate(b, 0, (t, x) -> t + x) AS at, s.offsets || array(s.at) AS offsets),
                s -> s.offsets)),
        offsets -> transform(flatten(zip_with(n.blocks, offsets, (b, o) -> aggregate(b,
                struct(o AS at, cast(array() AS array<int>) AS before),
                (s, x) -> struct(s.at + x AS at, s.before || array(s.at) AS before), s -> s.before))),
            (before, i) -> struct(before + length(n.gaps[i]) AS start,
                before + length(n.gaps[i]) + length(n.hits[i]) AS end, n.hits[i] AS value,
                right(n.gaps[i], {AROUND}) AS left, left(n.gaps[i + 1], {AROUND}) AS right)))[0])[0])[0]""")


def _spans(text: str, kind: str) -> Column:
    need = NEEDS[kind]
    tried = F.col(text).rlike("[0-9]") if kind != "email" else F.lit(True)
    if need:
        tried = (F.instr(F.col(text), need) > 0) & tried
    found = F.filter(_matches(text, FORMS[kind]), lambda m: F.lit(True))
    return F.when(tried, found).otherwise(F.filter(_matches("''", FORMS[kind]), lambda m: F.lit(False)))


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: id, ``th`` (hash of the text), ``base`` spans of all kinds in order, ``tokens`` with a digit or at sign."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "th", F.xxhash64("t"))
    rows = rows.select("*", *[_spans("t", kind).alias(kind) for kind in KINDS],
                       F.when(F.col("t").rlike("[0-9@]"), _matches("t", TOKEN)).alias("tokens"))
    parts = [F.expr(f"transform(filter({kind}, m -> {_valid(kind, 'm.value')}), m -> struct(m.start AS start, {number} AS "
                    f"place, m.end AS end, '{kind}' AS kind, m.value AS value, m.left AS left, m.right AS right))")
             for number, kind in enumerate(KINDS)]
    tokens = F.coalesce(F.col("tokens"), F.expr("filter(email, m -> false)"))
    return rows.select("id", "th", F.array_sort(F.concat(*parts)).alias("base"), tokens.alias("tokens"))


def _occurrences(scanned: DataFrame) -> DataFrame:
    """One row per base span and per token that meets no base span: id, th, start, end, kind (null: token), value, contexts."""
    base = scanned.select("id", "th", F.explode("base").alias("m")).select(
        "id", "th", "m.start", "m.end", "m.kind", "m.value", "m.left", "m.right")
    # A token without the punctuation at its ends.
    trimmed = scanned.select("id", "th", F.explode("tokens").alias("m")).select(
        "id", "th", "m.*", F.regexp_extract("m.value", r"^[^\p{L}\p{N}@+]*+", 0).alias("head"),
        F.regexp_replace("m.value", r"^[^\p{L}\p{N}@+]++|[^\p{L}\p{N}]++$", "").alias("body"))
    token = trimmed.select("id", "th", (F.col("start") + F.length("head")).alias("start"),
                           (F.col("start") + F.length("head") + F.length("body")).alias("end"),
                           F.lit(None).cast("string").alias("kind"), F.col("body").alias("value"), "left", "right"
                           ).where("length(value) > 0")
    rows = base.unionByName(token)
    before = Window.partitionBy("id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id", "th").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    of_base = F.col("kind").isNotNull()
    rows = (rows.withColumn("base_end", F.max(F.when(of_base, F.col("end"))).over(before))
            .withColumn("base_start", F.min(F.when(of_base, F.col("start"))).over(after)))
    free = ((F.coalesce("base_end", F.lit(0)) <= F.col("start"))
            & (F.col("base_start").isNull() | (F.col("base_start") >= F.col("end"))))
    return rows.where(of_base | free).drop("base_end", "base_start")


def _edges(occurrences: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, kind): the two words before, and the words on both sides."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]++", ""), r"\p{N}++", "0")
    before = F.filter(F.split(plain("left"), r"\s++"), lambda w: w != "")
    after = F.filter(F.split(plain("right"), r"\s++"), lambda w: w != "")
    patterns = F.array(
        F.when(F.size("before") > 1, F.concat(F.element_at(F.slice("before", -2, 2), 1), F.lit(" "),
                                              F.element_at("before", -1), F.lit(" _"))),
        F.when((F.size("before") > 0) & (F.size("after") > 0),
               F.concat(F.element_at("before", -1), F.lit(" _ "), F.element_at("after", 1))))
    return (occurrences.withColumns({"before": before, "after": after})
            .select(F.explode(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern"),
                    F.lower("value").alias("instance"), "kind").distinct())


def discover(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Instances that trusted patterns agree on: (instance, kind, score).

    A pattern's trust in a kind is the summed score of its instances over their number; it counts with a summed score of
    ``SUPPORT`` and a trust of ``TRUST``. An instance's score is 1 - product(1 - trust). Seeds keep score 1. An instance
    goes to its best kind, of equals the first name. A round is two aggregations with a map-side combine and two joins
    on the graph of distinct pairs, cut by a reliable checkpoint.
    """
    edges = stash(_edges(occurrences))
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    totals = edges.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    candidates = edges.where("kind is null").select("pattern", "instance").distinct()
    pairs = edges.select("pattern", "instance").distinct()
    scores = found = None
    for _ in range(rounds):
        known = seeds if found is None else seeds.unionByName(found.select("instance", "kind", "score"))
        trust = (pairs.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("weight"))
                 .where(F.col("weight") >= SUPPORT).join(totals, "pattern")
                 .withColumn("trust", F.col("weight") / F.col("n")).where(F.col("trust") >= TRUST))
        looks = F.lit(False)
        for kind, form in LOOKS.items():
            looks = looks | ((F.col("kind") == kind) & F.col("instance").rlike(form))
        scores = (candidates.join(trust.select("pattern", "kind", "trust"), "pattern").where(looks)
                  .groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("score"),
            F.count("*").alias("patterns")).where((F.col("score") >= ACCEPT) & (F.col("patterns") >= PATTERNS)))
        best = F.max_by("kind", F.struct("score", F.col("patterns"), -F.ascii("kind")))
        found = cut(scores.groupBy("instance").agg(best.alias("kind"), F.max("score").alias("score"))
                    .join(seeds.select("instance"), "instance", "left_anti"))
    return found


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``th`` (hash of the text), ``base`` and ``extra``: arrays of (start, end, kind, ...) spans.

    ``base`` are the valid matches of the fixed patterns, ``extra`` what the bootstrapping adds. Offsets are code points
    from 0, ends exclusive. A null text counts as empty and has none. Rows with equal id and text have equal results;
    rows that share an id, or have none, are told apart by their text. Other columns are not looked at. An empty table,
    or one without seeds, adds nothing.
    """
    scanned = stash(scan(docs, doc_id, text))
    occurrences = stash(_occurrences(scanned))
    found = discover(occurrences)
    extra = (occurrences.where("kind is null").drop("kind").withColumn("instance", F.lower("value"))
             .join(found.select("instance", "kind"), "instance")
             .groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("extra"))
             .select(F.col("id").alias("xid"), F.col("th").alias("xth"), "extra"))
    joined = scanned.join(extra, F.col("id").eqNullSafe(F.col("xid")) & (F.col("th") == F.col("xth")), "left")
    none = F.expr("cast(array() AS array<struct<start: int, end: int, kind: string>>)")
    return joined.select(F.col("id").alias(doc_id), "th", "base", F.coalesce("extra", none).alias("extra"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def ordered(*arrays: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    place = lambda kind: F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")
    return F.array_sort(F.concat(*[F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
        for a in arrays]))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns stay. Overlapping spans are one.

    ``n_chars`` names a column that is set to the new length. A null text stays null. One shuffle of the texts brings
    each to its spans; rows without spans are not changed.
    """
    spans = find(docs, doc_id, text).select(F.col(doc_id).alias("xid"), F.col("th").alias("xth"), F.explode(
        ordered(F.col("base"), F.col("extra"))).alias("s")).distinct()
    before = Window.partitionBy("xid", "xth").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    # What is kept before each span, and what stands for it; a span that begins inside another adds no label.
    cuts = (spans.withColumn("done", F.coalesce(F.max("s.end").over(before), F.lit(0)))
            .select("xid", "xth", F.struct(
                F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("done").alias("from"),
                F.when(F.col("s.start") >= F.col("done"), F.concat(F.lit("["), F.upper("s.kind"), F.lit("]")))
                .otherwise(F.lit("")).alias("label")).alias("cut"))
            .groupBy("xid", "xth").agg(F.array_sort(F.collect_list("cut")).alias("cuts"), F.max("cut.end").alias("last")))
    named = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = named.join(cuts, F.col(doc_id).eqNullSafe(F.col("xid")) & (F.col("__th") == F.col("xth")), "left")
    joined = joined.withColumn("__parts", F.when(F.col("cuts").isNotNull(), F.regexp_extract_all(
        F.col(text), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    piece = (f"substring(array_join(slice(__parts, PART_FROM div {PART} + 1, 1 + PART_TO div {PART} - PART_FROM div {PART}),"
             f" ''), PART_FROM % {PART} + 1, greatest(PART_TO - PART_FROM, 0))")
    kept = piece.replace("PART_FROM", "c.from").replace("PART_TO", "greatest(c.start, c.from)")
    new = F.when(F.col("cuts").isNull(), F.col(text)).otherwise(F.expr(
        f"array_join(transform(cuts, c -> concat({kept}, c.label)), '') || array_join(concat(array(substring("
        f"array_join(slice(__parts, last div {PART} + 1, 1), ''), last % {PART} + 1)), "
        f"slice(__parts, last div {PART} + 2, size(__parts))), '')"))
    columns = {text: new}
    if n_chars:
        columns[n_chars] = F.when(F.col("cuts").isNull(), F.col(n_chars)).otherwise(F.length(new).cast("long"))
    return joined.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])
