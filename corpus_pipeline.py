"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, langid, packing, pii, simhash, suffix
from plumbline.llm.common import col, forget, fresh, settled, table


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as long as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from all rows that have a language. A document of which no language can be told (no text, or no
    letter in it) goes; a null lang takes the predicted one. If no row has a language nothing is predicted, and only documents
    without a letter go."""
    profiles = langid.learn(docs)
    if not profiles:
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    names = fresh(docs, "found_lang", "found_score")
    found = langid.identify(docs, profiles, out=tuple(names)).filter(F.col(names[0]) != langid.UNKNOWN)
    return found.select(*[F.coalesce("lang", names[0]).alias("lang") if c == "lang" else col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that Jaccard similarities of 0.8 or more (five-word shingles) connect, the one with the least id
    stays. SimHash fingerprints of the shingles are linked by multi-index hashing; pairs that they do not reach are found by
    prefix filtering, and all are verified on complete sets."""
    return simhash.one_of_each(docs, near=jaccard.near_duplicates)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sparse suffix array: passages of 50 words or more that an earlier document or place holds go, and documents of which nothing is left."""
    return _measured(suffix.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Skip-chain CRF: personal data is replaced by its kind in angle brackets."""
    return _measured(pii.redacted(docs))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: where each piece of each document lies; documents whose fingerprints are linked share no bin."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("personal_data", personal_data), ("bins", bins)]
#: SQL cannot express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda f=stage, d=docs: f(spark, d, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
