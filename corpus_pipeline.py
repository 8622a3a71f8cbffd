"""A corpus pipeline: language identification, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in
the shared folder and reads it again for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antecede.llm import chosen_path
from antecede.llm.common import documents, save, ship
from antecede.llm.language_id import UNKNOWN, fit, predict
from antecede.llm.mixing import mixed_documents
from antecede.llm.packing import pack_documents
from antecede.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the likeliest language has this posterior or more.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a likely language; the others stay as they are. Where no document
    has a label there is nothing to reject by, and all documents with a letter stay."""
    ship(spark)
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    scored = predict(docs, model)
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the least doc_id (null last) stays. Rows without words are no
    copies of each other, and rows that share or lack a doc_id are told apart."""
    ship(spark)
    return chosen_path.drop_near_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 100 bytes or more that come earlier too. A character that is cut in half goes whole; a
    document of which nothing is left goes."""
    ship(spark)
    cut = remove_repeats(docs, as_text=True)
    some = F.col("n_removed") > 0
    left = cut.where(~some | (F.length("kept") > 0))
    changed = left.withColumn("text", F.when(some, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until each source has its target of words."""
    return mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Language models, near copies by shingles and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
