"""A training corpus from documents: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm import common, decontaminate, jaccard_join, language_id, line_dedup, packing
from dayweave.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter in their text and writes the found language to ``lang``.

    Where no language could be learned, documents with letters stay as they are.
    """
    prototypes = language_id.learn(docs.where(~language_id.held_out()))
    if not prototypes:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.identify(docs.select(*COLUMNS), prototypes)
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten or more documents share out of every text; documents stay."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least (id, hash of the text) of each class, once if its row is repeated; documents without an id stay."""
    rows = jaccard_join.row_classes(docs)
    first = (F.col("class_id") == F.col("doc_id")) & (F.col("class_body") == F.col("body"))
    marked = common.written(rows.where(~first | (F.col("copies") > 1)).select("doc_id", "body", first.alias("first")))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("body"))
    kept = keyed.join(marked.hint("shuffle_hash"), ["doc_id", "body"], "left_anti").select(*COLUMNS)
    repeated = marked.where("first")
    if repeated.isEmpty():
        return kept
    again = keyed.join(repeated.hint("shuffle_hash"), ["doc_id", "body"], "left_semi").groupBy("doc_id", "body").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.unionByName(again.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    found = decontaminate.contaminated_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(found.hint("shuffle_hash"), decontaminate.row_key() == F.col("doc"), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their ids, sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language prototypes and token ids have no SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
