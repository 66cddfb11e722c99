"""Registered queries of the training-data operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislewise.llm import (chat, classifier, codes, exact, mixing, packing, paragraphs, pii, rules,
                           simhash, toxicity, warc, whitening)
from aislewise.llm.common import table
from aislewise.session import stored

PII_KEY = b"replace this key in production"
TOKENIZER = "word_bpe_49k.json"  # a file of public_tokenizers


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op2_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, folder, "documents"), PII_KEY)
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "entities", "types")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.captures(table(spark, folder, "pages"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.measure(table(spark, folder, "documents"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.assess(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "removed_words")


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), "
                      "(-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
                      args={"said": said})
    return chat.read_back(stored(chat.examples(rows.unionByName(probe))))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.packed(table(spark, folder, "documents"), TOKENIZER)
    return found.select(F.col("id").alias("doc_id"), "start", "length",
                        F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
                        "sequence_id", "offset")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.assess(table(spark, folder, "documents"), table(spark, folder, "labels")
                             ).withColumnRenamed("id", "doc_id")


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.assess(table(spark, folder, "documents"), table(spark, folder, "labels")
                           ).withColumnRenamed("id", "doc_id")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    found = codes.encode(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), codes.code_string(F.col("codes")).alias("code"),
                        "error", "label_error", "codebooks_sha256")


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_packing": op9_packing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}



def _lloyd(parts: int = codes.PARTS, entries: int = codes.ENTRIES,
           rounds: int = codes.ROUNDS) -> str:
    """Plain Lloyd rounds over the parts of the integer vectors, round by round."""
    code = ["""v AS (SELECT vec_id, label,
                 [floor(1024 * c::DOUBLE)::BIGINT for c in embedding] AS x
               FROM embeddings WHERE embedding IS NOT NULL
               AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0)""",
            f"""p AS MATERIALIZED (SELECT vec_id, label, part,
                 x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}]::DOUBLE[] AS x
               FROM v, range({parts}) AS r(part))""",
            f"""b0 AS (SELECT part, row_number() OVER w - 1 AS entry, x AS c FROM p
               WINDOW w AS (PARTITION BY part ORDER BY vec_id) QUALIFY entry < {entries})"""]
    for k in range(rounds + 1):
        # Whole numbers below 2**53 are exact in doubles; the entry breaks ties of the distance.
        code.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label,
                 any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c)
                   + list_inner_product(c, c))::BIGINT * {entries} + entry) AS best
               FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)""")
        if k < rounds:
            code.append(f"""s{k} AS (SELECT part, best % {entries} AS entry, place,
                     sum(x[place])::BIGINT AS s, count(*) AS n
                   FROM a{k}, range(1, len(x) + 1) AS r(place) GROUP BY ALL)""")
            code.append(f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(new, c) AS c
                   FROM b{k} LEFT JOIN (SELECT part, entry, list(
                     ((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS new
                     FROM s{k} GROUP BY part, entry) AS q USING (part, entry))""")
    last = f"a{rounds}"
    return "WITH " + ",\n        ".join(code) + f""",
        h AS (SELECT sha256(string_agg(list_aggregate(c::BIGINT[], 'string_agg', ','), ','
                ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
        e AS (SELECT vec_id, any_value(label) AS label,
                string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code,
                sum(best // {entries})::BIGINT AS error FROM {last} GROUP BY vec_id)
        SELECT vec_id, code, error,
               (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM e, h"""


_ESCAPED = "regexp_replace({0}, '(<|\\[)(\\\\*)" + chat._REST + "', '\\1\\\\\\2\\3', 'g')"

_SPACE = "[\\x20\\x09-\\x0D]"

ORACLES = {
    "op12_vector_codes": _lloyd(),
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                          sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN
                min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op7_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, source,
                          coalesce(text, '') AS text FROM documents),
        w AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (
                SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d)),
        l AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w
              WINDOW o AS (PARTITION BY k ORDER BY i)),
        f AS (SELECT k, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY k, w, w1, w2) > 1 AS hit
              FROM l),
        c AS (SELECT k, count(*) AS n_words, count(*) FILTER (covered) AS n_repeat_words FROM (
                SELECT k, hit OR coalesce(lag(hit, 1) OVER o, false)
                       OR coalesce(lag(hit, 2) OVER o, false) AS covered
                FROM f WINDOW o AS (PARTITION BY k ORDER BY i)) GROUP BY k),
        raw AS (SELECT k, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
        lines AS (SELECT k, source, text, line, trim(regexp_replace(translate(line,
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '{_SPACE}+', ' ', 'g'), ' ') AS norm FROM raw
                  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        dup AS (SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY k),
        often AS (SELECT source, norm FROM (
                    SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY ALL) q
                  WHERE n > 20),
        gone AS (SELECT k, sum(len(string_split(norm, ' ')))::BIGINT AS removed_words
                 FROM lines JOIN often USING (source, norm) GROUP BY k),
        r AS (SELECT doc_id, coalesce(n_words, 0) AS n_words,
                 length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(removed_words, 0) AS removed_words
              FROM d LEFT JOIN c USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
               AND n_words - removed_words >= n_words * 0.5 AS kept FROM r""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
                 = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_chat_formatting": f"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        placed AS (
          SELECT *, row_number() OVER w - 1 AS place,
                 sum(23 + length(replace(replace({_ESCAPED.format("role")}, '%', '%25'),
                                         chr(10), '%0A')) + 1
                     + length({_ESCAPED.format("text")})) OVER w AS upto,
                 count(*) OVER (PARTITION BY conv_id) AS n
          FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                                 ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place))
                 AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place)
                               FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(upto) FILTER (role = 'assistant' OR place = n - 1)::BIGINT AS formatted_chars
        FROM placed GROUP BY conv_id""",
}
