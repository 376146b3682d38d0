"""One query per operator over its whole table, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stillwave.llm import byte_bpe, chat, collocations, lang_id, licences, mixing, near_dup, ngram_lm, nn_descent, pii, repair, simhash, spotsigs
from stillwave.llm.common import held_out
from stillwave.llm.licence_texts import LICENCES, SPELLINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


@query("op1_mix_sources", r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5('1:' || doc_id::VARCHAR) AS spot
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS n,
           1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w
    FROM d GROUP BY source),
-- Sources fill up in the order of size by weight: the share of those from k on is the first that fits the k-th.
o AS (
    SELECT *, row_number() OVER f AS k, sum(3 * n) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 3 * n AS full_before,
           sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(n) OVER () AS total
    FROM s WINDOW f AS (ORDER BY 3 * n / w, encode(coalesce(source, '')), source IS NULL)),
fits AS (
    SELECT min(k) AS k FROM o
    WHERE w * (total - full_before)::DOUBLE / w_left::DOUBLE <= 3 * n),
t AS (
    SELECT o.source, o.n, CASE WHEN o.k < fits.k THEN (3 * o.n)::DOUBLE
                               ELSE o.w * (a.total - a.full_before)::DOUBLE / a.w_left::DOUBLE END AS target
    FROM o, fits, o a WHERE a.k = fits.k),
r AS (
    SELECT d.doc_id, d.size, t.n AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY d.spot, d.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - upto + size)) END::BIGINT AS taken
FROM r
""")
def op1(spark, sf_dir):
    return mixing.weighted(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op2_near_duplicates")
def op2(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op3_personal_data")
def op3(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind in pii.KINDS],
                        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(pii.ordered(F.col("base"), F.col("extra"))).alias("spans"))


@query("op4_deleted_interpolation")
def op4(spark, sf_dir):
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return scored.withColumn("held_out", held_out("doc_id", 7, 2))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.learn(docs.where(~held_out("doc_id", 3, 1)))
    return (lang_id.label(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "n_spans"))


@query("op6_nn_descent")
def op6(spark, sf_dir):
    return nn_descent.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_spot_signatures")
def op7(spark, sf_dir):
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_chat_snapshots", r"""
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos,
           count(*) OVER (PARTITION BY conv_id) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (
    SELECT *, md5(string_agg(md5(coalesce('r' || role, '')) || md5(coalesce('t' || text, '')), '') OVER (
        PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h
    FROM t),
l AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY n, h),
k AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = l.n AND p.h = l.h))
SELECT k.conv_id, k.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
""")
def op9(spark, sf_dir):
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def _licence_sql() -> str:
    """The same in SQL, from the same fixed values."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(lower(coalesce(text, '')), '{licences.HOLDER}', '', 'g')"
    for variant, canonical in SPELLINGS:
        form = f"replace({form}, {text(variant)}, {text(canonical)})"
    lines = (f"list_filter(list_transform(string_split(regexp_replace({form}, '{licences.OTHER}', ' ', 'g'), chr(10)), "
             f"lambda s: trim(s)), lambda s: s <> '')")
    values = ", ".join(f"({text(name)}, {text(whole)})" for name, whole in LICENCES)
    return f"""
WITH k AS (SELECT array_to_string({lines}, ' ') AS form, min(name) AS license
           FROM (VALUES {values}) v(name, text) GROUP BY 1),
d AS (SELECT doc_id, {lines} AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS form FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
      FROM u JOIN k USING (form) GROUP BY doc_id)
SELECT d.doc_id, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON k.form = array_to_string(d.lines, ' ') LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op10_licence_digests", _licence_sql())
def op10(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, most=4)


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    return repair.repaired(table(spark, sf_dir, "conversations"))


@query("op13_collocations", r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
    SELECT lang, m, unnest(list_transform(range(1, len(ws)::BIGINT - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM w, (SELECT unnest(range(1, 6)) AS m)),
f AS MATERIALIZED (
    SELECT lang, phrase, m, count(*)::HUGEINT AS f, string_split(phrase, ' ') AS ws
    FROM g GROUP BY lang, phrase, m HAVING count(*) >= 100),
h AS (
    SELECT lang, f, m, unnest(range(2, m)) AS sub, ws FROM f WHERE m > 2),
i AS (
    SELECT lang, f, unnest(list_transform(range(1, m - sub + 2), lambda i: array_to_string(ws[i:i + sub - 1], ' '))) AS phrase
    FROM h),
x AS (SELECT lang, phrase, max(f) AS most FROM i GROUP BY lang, phrase),
c AS (
    SELECT f.*, unnest(range(1, m)) AS k FROM f LEFT JOIN x USING (lang, phrase)
    WHERE m > 1 AND (most IS NULL OR 100 * most < 100 * f)),
s AS (
    SELECT c.lang, c.phrase, c.f AS a, c.k, l.f AS l, r.f AS r, t.n, (1000 * c.f * t.n) // (l.f * r.f) AS score
    FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o WHERE rank <= 2000
""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
