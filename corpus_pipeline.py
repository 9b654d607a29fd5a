"""A training corpus from `documents`: five stages, each written as Parquet and read by the next.

The order is fixed: toxic documents go first, so that no group of near copies is represented by
one; near copies go before the corpus is searched for secrets and weighed; the tokens are those of
what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlode.llm import bpe, mixing, secrets, simhash, toxicity
from motorlode.llm.common import read, small, stored


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` without the rows of these doc_ids; rows with a null doc_id stay."""
    return docs.join(small(ids.select("doc_id").where("doc_id is not null").distinct()), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject, unchanged."""
    scores = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"))
    return without(docs, scores.where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays, the least by its other columns; rows of one
    doc_id with different texts are different documents and stay.
    """
    groups = stored(simhash.simhash_groups(docs))
    kept = without(docs, groups.where("doc_id <> component_id"))
    twice = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), "doc_id", "left_semi")
    one = again.groupBy("doc_id", "text").agg(F.min(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")))).alias("rest"))
    return without(kept, twice).unionByName(one.select("doc_id", "text", "rest.*").select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars counted again."""
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at the rates that bring sources, languages and topics to their targets."""
    return mixing.mix(docs).where(F.col(mixing.new_names(docs.columns)["kept"])).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, counted and digested, and what they decode to."""
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", tokenise)]

#: SQL can express neither the fingerprints nor the merges. tests/llm runs the five stages over a small corpus
#: and holds each against what its operator's own brute force or the library says of that stage's input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
