"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm import chat_format, decontaminate, html_template, jaccard_join, language_id, line_dedup, packing, prefix_trie, quality_rules, secret_scan, structure_repair, token_counts, topk_search
from dayweave.llm.common import table

#: The conversation that holds control strings of a bracket template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(extra)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text", language_id.held_out().alias("held_out")), prototypes).drop("text")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantize(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dayweave.session import cut_lineage

    measured = cut_lineage(quality_rules.statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").where(~quality_rules.held_out()).select("doc_id", F.col("quality").alias("label"))
    model = quality_rules.fit(measured.join(labels, "doc_id"))
    scored = measured.select("doc_id", quality_rules.held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"), borrow=True)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair(structure_repair.damaged(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

OP2_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(3 + length(role) + 1 + length(text) + 4
                + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '[', ''))
                + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '[', ''))) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_format": op2_chat_format,
    "op3_language_id": op3_language_id,
    "op4_exact_topk": op4_exact_topk,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_chat_format": OP2_SQL,
    "op4_exact_topk": OP4_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op11_secret_scan": secret_scan.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_structure_repair": structure_repair.OP13_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
