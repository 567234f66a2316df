"""A training-data pipeline in five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; stages are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logoscope.llm import exact_dedup, jaccard_join, packing, pii, quality, token_shards
from logoscope.llm.queries import id_remainder
from logoscope.llm.shared import discard, new_path, save

#: Documents with a lower calibrated score go.
LEAST_QUALITY = 0.5
#: Vocabulary whose ids fill the training sequences, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels outside the held-out quarter.

    Null and empty texts are scored like any other; rows of a repeated or null id are scored one by one; an empty table
    stays empty; other columns pass unchanged, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_remainder(4) != 2)
    return quality.keep_good(docs, labels, LEAST_QUALITY)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, null and blank texts being one group.

    Rows of one id and text stay or go together; of rows without an id one stays for each text that no other has."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more over five-word shingles tie together.

    Texts without words link with nothing and stay, as do rows without an id; rows of a repeated id stay or go together."""
    return jaccard_join.drop_near_copies(docs, k=5, similarity=(80, 100))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms generalised to the names of their kinds; every row stays, null texts as null."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in training sequences, by token ids. Every row has a piece, as a null or empty text has its
    end token; rows of a repeated id are packed each."""
    counted = token_shards.token_counts(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return packing.pack(counted, F.col("n_tokens"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("pii", hide_private),
    ("packing", pack_sequences),
]

#: SQL can't express the fitted classifier or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is deleted when the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        docs = save(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
