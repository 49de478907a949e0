"""From raw documents to token ids, in stages that each take what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame, which run() writes as Parquet in the shared folder and rereads as
the next one's docs. All but the last give the columns of documents. Columns
unknown to a stage pass through, whatever their names; null texts are empty
ones; empty tables stay empty.

  quality rules    documents that fail the base rule or a learnt rule go
  near duplicates  of each group of near copies the document of least id stays
  decontamination  documents with a benchmark window go
  personal data    findings are replaced by pseudonyms of their format
  tokens           ids of each text, checked by decoding them
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _io, bpe, decontaminate, pii, rules, simhash

#: SQL can't say learnt rules, components or merges; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.good_documents(docs, _io.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, _io.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, pii.DEMO_KEY, counts=False)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])).select(docs.columns) if "n_chars" in kinds else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select("doc_id", "text"), path, pattern, round_trip="round_trip")
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _io.table(spark, sf_dir, "documents"), _io.own_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
