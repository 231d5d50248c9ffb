"""The registered queries of this package: each operator on its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.llm import (
    bpe,
    exact_dedup,
    extraction,
    importance,
    langid,
    packing,
    perspectives,
    quality,
    simhash,
    spelling,
    superkmers,
    token_files,
    toxicity,
)
from lakesearch.llm.common import remainder, table
from lakesearch.session import ship_package


def op1_perspective_chat(spark: SparkSession, folder: str) -> DataFrame:
    rendered = perspectives.perspectives(table(spark, folder, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return rendered.select(
        "conv_id", "participant", "block", "n_turns", "text", F.array_join(spans, ",").alias("mask")
    )


def op2_backoff_language(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    found = langid.identify_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    learnt = table(spark, folder, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(toxicity.labelled_sample(docs, learnt))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_genetic_packing(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op5_mincut_extraction(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return extraction.extract(table(spark, folder, "pages"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op7_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


def op9_numpy_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return bpe.encode_decode(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op10_superkmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    kept = superkmers.drop_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op11_pivotal_spelling(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spelling.variants(table(spark, folder, "documents"))


def op12_arrow_token_files(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return token_files.token_digests(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return importance.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_perspective_chat,
        op2_backoff_language,
        op3_counterfactual_toxicity,
        op4_genetic_packing,
        op5_mincut_extraction,
        op6_quality_rules,
        op7_simhash_trie,
        op8_exact_dedup,
        op9_numpy_bpe,
        op10_superkmer_dedup,
        op11_pivotal_spelling,
        op12_arrow_token_files,
        op13_importance_resampling,
    )
}

#: CRC-32 of a list of bytes, by its table; the macros' bodies, for use inside the SQL below.
_CRC_TABLE = """
        crc_table AS (
            SELECT list(c ORDER BY i) AS crcs
            FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                         CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
                  FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(code_units: str) -> str:
    """SQL for the CRC-32 of a list of byte values; `crcs` is the table's list."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {code_units}), "
        "lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])))"
    )


def _bytes(text: str) -> str:
    """SQL for the UTF-8 bytes of a text, as a list of numbers."""
    return (
        f"list_transform(range(0, octet_length(encode({text}))), "
        f"lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    )


# Queries without SQL are tested against brute force, the tokenizers library or held-out labels.
ORACLE = {
    "op1_perspective_chat": """
        WITH turns AS (
            SELECT conv_id, role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST,
                                      role NULLS FIRST, coalesce(text, '')) - 1 AS pos
            FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS participant FROM conversations
                     WHERE role IS NOT NULL AND role <> 'system'),
        segments AS (
            SELECT t.conv_id, participant, pos // 64 AS block, pos,
                   role IS NOT DISTINCT FROM participant AS own,
                   CASE WHEN role = participant THEN '<|assistant|>'
                        WHEN role = 'system' THEN '<|system|>'
                        WHEN role IS NULL THEN '<|user|>'
                        ELSE '<|user name=' || replace(replace(replace(replace(replace(role,
                             '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), chr(10), '\\n'), chr(13), '\\r')
                             || '|>'
                   END || chr(10) AS head,
                   replace(replace(text, '\\', '\\\\'), '<|', '<\\|') || '<|end|>' || chr(10) AS body
            FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        placed AS (
            SELECT *, sum(length(head) + length(body)) OVER (
                          PARTITION BY conv_id, participant, block ORDER BY pos) - length(body) AS start
            FROM segments)
        SELECT conv_id, participant, block, CAST(count(*) AS INTEGER) AS n_turns,
               string_agg(head || body, '' ORDER BY pos) AS text,
               coalesce(string_agg(CASE WHEN own THEN CAST(start AS VARCHAR) || '-' ||
                                   CAST(start + length(body) AS VARCHAR) END, ',' ORDER BY pos),
                        '') AS mask
        FROM placed GROUP BY conv_id, participant, block""",
    "op6_quality_rules": f"""
        WITH parts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
            FROM documents),
        windows AS (
            SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
        repeated AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows)
            WHERE n > 1),
        covered AS (
            SELECT r, count(DISTINCT i + k) AS n_repeat_words
            FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
        measured AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                   len(l) AS n_lines,
                   len(list_filter(w, lambda x: list_contains({quality.STOP_WORDS}, lower(x))))
                       AS n_stop_words
            FROM parts LEFT JOIN covered USING (r)),
        base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
                 FROM measured)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND {quality.rules_sql()} AS kept
        FROM base""",
    "op8_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM normal""",
    "op11_pivotal_spelling": f"""
        WITH {_CRC_TABLE},
        runs AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r,
                   count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r
                  FROM documents)
            WHERE length(r) >= 7 GROUP BY ALL),
        hashed AS (
            SELECT r, n, {_crc32(_bytes("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r"))} AS h
            FROM runs, crc_table),
        words AS (
            SELECT w, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2)
                              ELSE r END AS w, n FROM hashed)
            WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
        less AS (
            SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d
            FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
        near AS (
            SELECT a.w, b.w AS v, b.n FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.w <> b.w
            UNION SELECT less.w, words.w, words.n FROM less JOIN words ON d = words.w
            UNION SELECT words.w, less.w, less.n FROM less JOIN words ON d = words.w),
        best AS (SELECT w, count(*) AS n_near, max(n) AS most FROM near GROUP BY w),
        formed AS (
            SELECT w, words.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN most >= 10 * words.n
                        THEN (SELECT min(v) FROM near WHERE near.w = words.w AND near.n = most) END AS form,
                   CASE WHEN most >= 10 * words.n THEN most END AS form_n
            FROM words LEFT JOIN best USING (w)),
        hops AS (
            WITH RECURSIVE hop AS (
                SELECT w, form AS onward, 1 AS k FROM formed WHERE form IS NOT NULL
                UNION ALL
                SELECT hop.w, formed.form, k + 1 FROM hop JOIN formed ON hop.onward = formed.w
                WHERE formed.form IS NOT NULL)
            SELECT w, arg_max(onward, k) AS root FROM hop GROUP BY w)
        SELECT w AS word, form, coalesce(root, w) AS root, n, n_near, form_n
        FROM formed LEFT JOIN hops USING (w)""",
    "op13_importance_resampling": f"""
        WITH {_CRC_TABLE},
        texts AS (
            SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
            UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
        listed AS (
            SELECT kind, id, r, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts),
        found AS (
            SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
                   AS f FROM listed),
        counted AS (SELECT kind, r, f, count(*) AS n FROM found GROUP BY ALL),
        hashed AS (
            SELECT f, {_crc32(_bytes("f"))} % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM counted), crc_table),
        placed AS (SELECT kind, r, bucket, CAST(sum(n) AS BIGINT) AS n
                   FROM counted JOIN hashed USING (f) GROUP BY ALL),
        shares AS (
            SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t
            FROM placed GROUP BY bucket),
        totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM shares),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)
                       / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM shares, totals),
        weighed AS (
            SELECT r, CAST(sum(n) AS BIGINT) AS n_features,
                   CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
            FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
        scored AS (
            SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
                   coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
                       '7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                       / 4294967296))) AS BIGINT) AS score
            FROM listed LEFT JOIN weighed USING (r) WHERE kind = 'd'),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                   25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn
            FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
        FROM ranked""",
}
