"""The registered queries of the training-data operators: whole tables in, whole results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import ann, chat, decontam, dedup, langid, licenses, lm, mixing, pii, tokens
from weirflow.llm._shared import id_crc32, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The vocabulary file's place; the package that holds it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    p = mixing.plan_mix(written(docs, "counted"), cycle=(5, 2, 1), max_repeat=3, size_col="size")  # texts are read once
    return p.select("doc_id", "size", F.col("__wf_source_size").alias("source_size"), F.col("__wf_target").alias("target"), (F.col("__wf_size") * F.col("__wf_copies")).cast("long").alias("taken"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_file(), end_id=0))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.pmod(id_crc32("doc_id"), F.lit(7))
    return lm.interpolated_scores(_table(spark, sf_dir, "documents"), held_out=r == 2, em_fold=r == 3)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_report(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_examples(chat.training_examples(turns.unionByName(more)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(id_crc32("doc_id"), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(langid.training_sample(docs, ~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("__wf_lang").alias("lang_pred"), F.col("__wf_score").alias("score"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(_table(spark, sf_dir, "documents"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.report(docs, _table(spark, sf_dir, "benchmark"), size=8, least_items=2).drop("text")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_files, op3_nearest, op4_lm_scores, op5_licences, op6_chat, op7_language, op8_near_duplicates, op9_personal_data, op10_contamination)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_mixing": r"""
        WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        d AS (SELECT *, (size >> greatest(length(bin(size)) - 8, 0)::BIGINT) << greatest(length(bin(size)) - 8, 0)::BIGINT AS class FROM w),
        s AS (SELECT source, sum(size)::BIGINT AS size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
        b AS (SELECT *, sum(size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
            coalesce(sum(3 * size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
            FROM s WINDOW o AS (ORDER BY size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, (all_size - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM b),
        c AS (SELECT *, (3 * size)::DOUBLE <= level * weight AS capped FROM l),
        t AS (SELECT source, size AS source_size, CASE WHEN capped THEN (3 * size)::DOUBLE ELSE (SELECT arg_min(level, weight_before) FROM c WHERE NOT capped) * weight END AS target FROM c),
        n AS (SELECT source, class, count(*) AS n FROM d GROUP BY ALL),
        z AS (SELECT source, class, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.target, z.n, z.before, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
            ('0x' || substr(md5('17:' || coalesce(d.source, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift,
            ('0x' || substr(md5('17:document:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN z ON d.source IS NOT DISTINCT FROM z.source AND d.class = z.class),
        a AS (SELECT *, rate - floor(rate) AS part, shift + (rate - floor(rate)) * (before::DOUBLE + n::DOUBLE * u) AS place FROM r)
        SELECT doc_id, size, source_size, target, (size * least(floor(rate) + CASE WHEN part > 0 AND place - floor(place) < part THEN 1 ELSE 0 END, 3))::BIGINT AS taken FROM a""",
    "op6_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, length(text) + length(text) - length(translate(text, '\<[', '')) + length(role) + length(role) - length(translate(role, '\<[|', '')) + 8 AS size,
            role = 'assistant' AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
        p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS n FROM e)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (own), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (own), '')) AS loss_sha256,
            (coalesce(sum(upto) FILTER (own OR i = n), 0))::BIGINT AS formatted_chars
        FROM p GROUP BY conv_id""",
    "op8_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
        x AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM o WHERE 100 * same >= 80 * (na + nb - same)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id""",
    "op10_contamination": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) AS g
            FROM (SELECT item_id, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0)),
        n AS (SELECT DISTINCT n FROM i),
        p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, n WHERE len(w) >= n),
        g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM p),
        h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n),
        q AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
