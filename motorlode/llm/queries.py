"""The registered queries of this subpackage: (spark, data folder) to DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorlode.llm import bpe, mincut, mixing, paragraphs, secrets, simhash, sketch, substrings, toxicity, vectors
from motorlode.llm.common import read, whole_texts


def op1_collisions(spark, sf_dir):
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op2_secrets(spark, sf_dir):
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op3_main_text(spark, sf_dir):
    return mincut.extract(read(spark, sf_dir, "pages"))


def op4_bottom_k(spark, sf_dir):
    return sketch.fingerprint_documents(read(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_mixing(spark, sf_dir):
    return mixing.op6_rows(read(spark, sf_dir, "documents"))


def op8_paragraphs(spark, sf_dir):
    return paragraphs.document_repeats(read(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_substrings(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_collisions, op2_secrets, op3_main_text, op4_bottom_k, op5_simhash, op6_mixing, op7_byte_bpe, op8_paragraphs, op9_toxicity, op10_substrings)}

#: DuckDB SQL by query. Those without are tested in tests/llm: op2 (base kinds), op5, op7, op8 (lines and
#: pieces), op9 (the bigram models' mean ratio) and op10 against brute force or the library, op4 by the sets
#: that sketches estimate, op3 by pages with known text, and its cut by trying all labellings.
ORACLES: dict[str, str] = {"op1_collisions": vectors.ORACLE, "op6_mixing": mixing.ORACLE}
