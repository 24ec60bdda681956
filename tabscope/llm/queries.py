"""The registered queries of the operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import alignment, chat, decontaminate, jaccard, language, licenses, mixing, packing, quality
from tabscope.llm import search, secrets, tokens, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"

# -- 1: chat formatting ------------------------------------------------------------------------------------------

# The conversation that is added, whose texts look like marks of the template.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _escaped_length(column: str) -> str:
    found = " + ".join(
        f"(length({column}) - length(replace({column}, '{mark}', ''))) // {len(mark)}"
        for mark in (*chat.CONTROL_STRINGS, "\\")
    )
    return f"(length({column}) + {found})"


@query(
    "op1_chat_formatting",
    f"""WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
        (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
    placed AS (
      SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        sum({_escaped_length("role")} + {_escaped_length("text")} + 8) OVER w AS chars FROM rows_
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place), ''))
        AS loss_sha256,
      CAST(sum(CASE WHEN role = 'assistant' OR place = n THEN chars END) AS BIGINT) AS formatted_chars
    FROM placed GROUP BY conv_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return chat.conversation_digest(chat.prefix_target_examples(given.unionByName(added)))


# -- 2: quality rules --------------------------------------------------------------------------------------------


_QUALITY_SQL = r"""WITH texts AS (
      SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    places AS (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM texts WHERE len(w) > 3),
    grams AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w[i], w[i + 1], w[i + 2]) AS n FROM places),
    repeats AS (SELECT row_no, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY row_no),
    features AS (
      SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered
      FROM texts t LEFT JOIN repeats r ON t.row_no = r.row_no),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
      CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
      NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 2 * n_dup_lines > n_lines OR 10 * n_lettered < 7 * n_words) AS kept
    FROM judged"""


@query("op2_quality_rules", _QUALITY_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_cascade(
        table(spark, sf, "documents"), report=quality.BASE, verdicts={"base_failed": quality.BASE_RULES}
    )


# -- 3: WARC derivatives -----------------------------------------------------------------------------------------


@query("op3_warc_derivatives")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, sf, "pages")))


# -- 4: packing --------------------------------------------------------------------------------------------------

CAPACITY = 2048


def packed(docs: DataFrame, remembered: int = packing.REMEMBERED_CHUNKS) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD_TOKENIZER), CAPACITY, remembered=remembered)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, CAPACITY)


@query("op4_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


# -- 5: license scans --------------------------------------------------------------------------------------------


def _license_sql() -> str:
    rows = ", ".join(f"('{name}', {licenses.template_bigrams(text)})" for name, text in licenses.TEMPLATES.items())
    return f"""WITH templates AS (SELECT * FROM (VALUES {rows}) v(license, grams)),
    lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    segments AS (
      SELECT doc_id, unnest(range(len(parts))) AS segment, unnest(parts) AS part FROM lines
      UNION ALL SELECT doc_id, -1, text FROM lines WHERE len(parts) > 1),
    words AS (
      SELECT doc_id, segment, list_filter(string_split(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), ' '),
        lambda w: w <> '') AS w FROM segments),
    grams AS (
      SELECT doc_id, segment, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS own FROM words
      WHERE len(w) > 1),
    compared AS (
      SELECT doc_id, segment, license, len(own) AS n_bigrams, len(list_intersect(own, grams.grams)) AS overlap, grams.size
      FROM (SELECT g.*, t.license, t.grams, len(t.grams) AS size FROM grams g, templates t) grams)
    SELECT doc_id, CAST(segment AS BIGINT) AS segment, license, CAST(n_bigrams AS BIGINT) AS n_bigrams,
      CAST(overlap AS BIGINT) AS overlap, round(2.0 * overlap / (n_bigrams + size), 6) AS dice
    FROM compared WHERE round(2.0 * overlap / (n_bigrams + size), 6) >= {licenses.LEAST_DICE}"""


@query("op5_license_scans", _license_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


# -- 6: secret scans ---------------------------------------------------------------------------------------------


def scanned(docs: DataFrame) -> DataFrame:
    return secrets.scan_secrets(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query("op6_secret_scans")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scanned(table(spark, sf, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


# -- 7: benchmark decontamination --------------------------------------------------------------------------------


@query("op7_decontamination")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# -- 8: n-gram Jaccard join --------------------------------------------------------------------------------------


@query("op8_jaccard_join")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"))


# -- 9: token counts ---------------------------------------------------------------------------------------------


@query("op9_token_counts")
def _(spark: SparkSession, sf: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return tokens.length_histogram(counted)


# -- 10: language ID ---------------------------------------------------------------------------------------------

# The fold of a document, by the remainder of its key's checksum.
FOLDS, HELD_OUT = 4, 2


def fold(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.train_language_model(docs.where(~fold(docs)))


@query("op10_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify_languages(docs, language_model(docs))
    return found.withColumn("held_out", F.coalesce(fold(docs), F.lit(False)))


# -- 11: ranked lexical search -----------------------------------------------------------------------------------

_SEARCH_SQL = r"""WITH texts AS (
      SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    words AS (SELECT row_no, unnest(terms) AS term FROM texts),
    frequencies AS (SELECT row_no, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT row_no, doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM frequencies, total GROUP BY term, docs),
    asked AS (
      SELECT item_row, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS item_row, item_id, unnest(
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    scores AS (
      SELECT item_row, item_id, row_no, doc_id,
        CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM asked JOIN frequencies USING (term) JOIN weights USING (term) JOIN sizes USING (row_no), total GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS rank FROM scores
      WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op11_ranked_search", _SEARCH_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), top=10)


# -- 12: mixing sources to target weights ------------------------------------------------------------------------

MIX_CYCLE, MIX_SHARE, MIX_CAP, MIX_SEED = (3, 1, 2), 1.5, 2.0, 42

_MIX_SQL = rf"""WITH RECURSIVE docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5('{MIX_SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS digest
      FROM documents),
    drawn AS (SELECT doc_id, source, size, CAST('0x' || digest[1:3] AS INTEGER) AS step,
      CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INTEGER) ELSE 0 END AS cls FROM docs),
    sources AS (
      SELECT source, sum(size) AS s, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]
        ::DOUBLE AS w FROM drawn GROUP BY source),
    ordered AS (
      SELECT sum(s) OVER () AS total, coalesce(sum(s) OVER before, 0) AS cut, sum(w) OVER after AS weights
      FROM sources WINDOW before AS (ORDER BY 2.0 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (ORDER BY 2.0 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    level AS (SELECT max((1.5::DOUBLE * total - 2.0::DOUBLE * cut) / weights) AS x FROM ordered),
    targets AS (SELECT source, s, least(2.0::DOUBLE * s, x * w) AS target FROM sources, level),
    rates AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS INTEGER) ELSE 0 END AS whole FROM targets),
    cells AS (SELECT source, cls, step, sum(size) AS words FROM drawn GROUP BY ALL),
    classes AS (SELECT source, cls, sum(words) AS words, list(step ORDER BY step) AS steps, list(words ORDER BY step) AS parts
      FROM cells GROUP BY source, cls),
    walk AS (
      SELECT source, 48 AS cls, target - whole * s AS owed, CAST(s AS DOUBLE) AS rest, 0 AS taken FROM rates
      UNION ALL
      SELECT source, cls, owed - coalesce(list_sum([parts[i] for i in range(1, len(steps) + 1) if steps[i] < t]), 0), rest - words, t
      FROM (SELECT w.source, w.cls - 1 AS cls, owed, rest, coalesce(c.words, 0) AS words, coalesce(c.steps, []) AS steps,
          coalesce(c.parts, []) AS parts,
          CASE WHEN rest > 0 THEN CAST(floor(least(greatest(owed / rest, 0), 1) * 4096 + 0.5) AS INTEGER) ELSE 0 END AS t
        FROM walk w LEFT JOIN classes c ON w.source IS NOT DISTINCT FROM c.source AND c.cls = w.cls - 1 WHERE w.cls > 0))
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
      CAST(size * (whole + CASE WHEN s > 0 AND step < taken THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
      JOIN walk w ON d.source IS NOT DISTINCT FROM w.source AND d.cls = w.cls AND w.cls < 48"""


@query("op12_source_mixing", _MIX_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix_copies(docs, MIX_CYCLE, MIX_SHARE, MIX_CAP, MIX_SEED).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


# -- 13: cross-tokenizer alignment -------------------------------------------------------------------------------

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op13_tokenizer_alignment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.align_tokenizers(table(spark, sf, "documents"), *files)
