"""Registered queries of the text operators (``opN_<name>`` and ``pipeline``), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from platelens.llm import conversations, decontaminate, extraction, langid, lexical, mixing, neighbours, packing, quality, sharding, simhash, substrings, tokens
from platelens.llm.common import read_table

Run = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of near copies for every document."""
    return simhash.simhash_components(read_table(spark, sf, "documents"))


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document; equal texts together, bytes near equal."""
    return sharding.digest(read_table(spark, sf, "documents"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    return tokens.count_tokens(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extraction.extract(read_table(spark, sf, "pages"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and toxicity of every document."""
    return quality.rate(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.digest(read_table(spark, sf, "documents"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the item and its distance."""
    return decontaminate.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op8_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.digest(read_table(spark, sf, "documents"))


def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every hundredth id."""
    return neighbours.search(read_table(spark, sf, "embeddings"))


def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document, and those left without passages that a smaller document has."""
    return substrings.digest(read_table(spark, sf, "documents"))


def op11_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversations.digest(read_table(spark, sf, "conversations"))


def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    import public_tokenizers

    return packing.pack(read_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Run] = {f.__name__: f for f in (
    op1_simhash, op2_sharding, op3_token_counts, op4_extraction, op5_quality, op6_mixing, op7_decontamination, op8_langid, op9_neighbours,
    op10_substrings, op11_conversations, op12_lexical, op13_packing,
)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op10_substrings": substrings.SQL, "op11_conversations": conversations.SQL, "op12_lexical": lexical.SQL}
