"""The registered queries of this package: one per operator, and the pipeline."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import (ann, bpe, chat_format, epsilon_grid, fim, language_id, mixing, quality, repair, substring_dedup,
                          suffix_dedup, url_filter, vertical_join)
from feedlake.llm.common import table


def _covered(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id")


def op2_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search_every(table(spark, sf_dir, "embeddings"), every=20, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_symbols").alias("n_words"), _covered("spans").alias("n_removed"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("n_symbols").alias("n_bytes"), _covered("spans").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op7_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vertical_join.jaccard_groups(table(spark, sf_dir, "documents"), threshold=90, words=3)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_grid.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "epoch", "block", "n_tokens")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(said).alias("text"))
    events = chat_format.conversation_events(rows.unionByName(control))
    back = chat_format.read_back(chat_format.format_events(events))
    transcript = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(transcript).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"),
                       digest("restored").alias("restored_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "lang", "text"))
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))
    return (language_id.predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repair(damaged, F.col("lost")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.encode(repair.transcript(), "UTF-8"), 256).alias("repaired_sha256"))


ORACLE_SQL = {
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM g""",
    "op6_url_filter": r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host || r.path) DESC) AS k
      FROM h LEFT JOIN r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op10_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length('<|turn|>') + length('<|text|>') + length('<|end|>')
        + length(regexp_replace(regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g'), 'x^', '', 'g'))
        + length(regexp_replace(role, '([<\[]\\*)(\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                  (('0x' || left(md5(doc_id::VARCHAR), 3))::INT % 1024)::INT AS block FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens)::DOUBLE AS total, count(*) FILTER (tokens > 0) AS k FROM s),
g AS (SELECT i, sum(pow(tokens / total, i / 1024.0)) AS z, sum(pow(tokens / total, i / 1024.0) * ln(tokens / total)) AS zl,
             min(tokens / total) AS low, any_value(k) AS k
      FROM s, t, (SELECT unnest(range(1025)) AS i) WHERE tokens > 0 GROUP BY i),
p AS (SELECT greatest(coalesce(max(i) FILTER (ln(z) - i / 1024.0 * zl / z >= 0.97 * ln(k) - 1e-9), 0),
                      coalesce(min(i) FILTER (pow(low, i / 1024.0 - 1) / z <= 4 + 1e-9), 1024)) AS i FROM g),
w AS (SELECT source, tokens, floor(pow(tokens / total, p.i / 1024.0) / z * total + 1e-6)::BIGINT AS budget
      FROM s, t, p, g WHERE g.i = p.i AND tokens > 0),
m AS (SELECT source, budget // tokens AS full_passes, budget % tokens AS rest FROM w),
o AS (SELECT d.*, full_passes, rest, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY
             md5(full_passes || ':block:' || block), block, md5(full_passes || ':doc:' || doc_id), doc_id) AS upto
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, source, unnest(range(full_passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END))::INT AS epoch, block, n_tokens FROM o""",
}


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
