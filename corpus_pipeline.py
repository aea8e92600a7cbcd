"""The corpus pipeline: language ID, toxicity, near-duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`documents`; the last returns each kept document's ids as digests. Every stage keeps null ids and repeated rows as they
stand (a repeated row is kept or dropped with its like), drops columns beyond those of `documents`, reads whole texts of any
length, and turns an empty table into an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import byte_bpe, byte_cnn, fm_index, order_minhash, toxicity
from leafmill.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of this probability or more are toxic.
TOXIC = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts, texts without a letter, and those scored lower than texts of known languages are."""
    model = byte_cnn.learn(docs)
    return byte_cnn.identified(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= model["least"])).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go; the labels of the documents still there are learned from."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    others = order_minhash.classes(docs).where(~F.col("is_first")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return fm_index.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0).select(*COLUMNS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode_bytes),
]

#: Trained models, sketches and merges take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
