"""The corpus pipeline: quality, language, near-duplicates, mixing, SentencePiece encoding.

Each stage takes what its predecessor kept, decides about all of it and returns the columns of ``documents``; the last returns tokens.

- quality: documents that the classifier scores under 0.5 go.
- language: documents without a letter, and those in which no learned language holds ``LEAST_SHARE`` of the words, go.
- near_duplicates: of each group linked by ``SIMILARITY`` of their shingles of ``SHINGLE`` words or more one document stays.
- mix: sources are drawn to their target weights; a document has a row for each shard and pass that draws from it, with the drawn words. Rows stand in
  the order of their shards, and in the shuffled order of their draws inside.
- encode: ids of every text with the span of source bytes of each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.langid import keep_identified, train
from furrow.llm.mixing import drawn_texts
from furrow.llm.pieces import encode_texts
from furrow.llm.quality import keep_good
from furrow.llm.queries import remainder, tokenizer_path
from furrow.llm.similar import keep_one
from furrow.session import stored, table

LEAST_SHARE = 0.3
SHINGLE = 5
SIMILARITY = 0.8
MIX_BLOCK = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, train(docs, F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))), LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, shingle=SHINGLE, least=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drawn_texts(docs, block=MIX_BLOCK)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), decode=False)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "first_bytes", "end_bytes")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix_sources), ("encode", encode)]

#: Scores, hypergeometric draws and pieces are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
