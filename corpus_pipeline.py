"""From raw documents to packed training sequences, in five stages, each written before the next one reads it.

A stage reads stored Parquet files, keeps all columns as they are (the last one aside), and gives no rows for no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, Stored, documents, importable, keep_rows
from usagelens.llm.exact_dedup import exact_duplicates
from usagelens.llm.langid import UNKNOWN, language_id
from usagelens.llm.mixing import mix
from usagelens.llm.packing import pack_documents
from usagelens.llm.similar import similar_groups

#: The whole can't be said in SQL: it holds trained profiles, fingerprints and pseudo-random choices.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, or no letter in it. Profiles are learned from all rows with lang."""
    return keep_rows(docs, language_id(docs, F.lit(True)).filter(F.col("lang_pred") != UNKNOWN))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the one with most code points stays, then the smallest doc_id."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (shingles of five words, similarity of 0.8 or more) the smallest doc_id stays.

    SimHash proposes, the similarity itself decides; what SimHash cannot see is sought as well (see ``similar_links``).
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW]
    return keep_rows(docs, similar_groups(docs).groupBy("component").agg(first.alias(ROW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: from never to three times."""
    taken = mix(docs).filter("copies > 0")
    return keep_rows(docs, taken.select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1,024 tokens."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage but the last is kept in the shared folder."""
    importable(spark)
    store = Stored(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
