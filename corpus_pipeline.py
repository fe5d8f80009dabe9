"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet and rereads it as the next stage's docs.  The first four return
the columns of documents, the last one row per document with ids and decoded text.

Edge cases, by stage: language ID drops null texts and those without a letter, as they
have no language; line dedup leaves texts without a line as they are and empties
those whose lines all go; near-dedup keeps texts without a word once (they share
fingerprint zero); mixing rates a text without a token like any other; rows with a null
id pass all stages (mixing draws for them as one id); repeated rows count as copies of
each other in line dedup, and stay or go together elsewhere; very long texts pass every
stage whole; of equal choices the smallest id stays (line dedup: the first line of it),
so ties do not depend on partitions; an empty table passes empty; extra columns pass
unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import langid, lines, mixing, near_docs, pieces
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import free_name

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

#: Five words a shingle for near-duplicates of documents.
SHINGLE_WORDS = 5
LEAST_JACCARD = 0.8


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; the others stay as they are."""
    model = langid.fit_languages(docs.where(F.col("doc_id").isNotNull()))
    made = tuple(free_name(docs.columns, c) for c in ("lang_pred", "score", "rejected"))
    judged = langid.identify_language(docs, model, made=made, keep_text=True)
    return judged.where(~F.col(made[2])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate lines one stays; n_chars follows the text."""
    return lines.drop_duplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays.

    Documents are linked within two bits of SimHash or from a Jaccard similarity of LEAST_JACCARD.
    At that similarity about ten of 64 bits differ, where no positional byte is guaranteed
    to be shared, so most of these links come from MinHash bands and exact verification.
    """
    return near_docs.drop_near_documents(docs, SHINGLE_WORDS, LEAST_JACCARD)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with the chance that its rate gives it; a rate of one or more keeps it."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = tuple(free_name(docs.columns, c) for c in ("n_tokens", "posterior", "rate"))
    rated = mixing.mix_to_targets(docs, labels, mixing.TARGETS, made=made, keep_text=True)
    return rated.where(mixing.draw(F.col("doc_id")) < F.col(made[2])).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, with its other columns; ids and decoded replace columns of these names."""
    return pieces.encode_decode(docs, TOKENIZER)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_domains),
    ("sentencepiece", encode),
]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
