"""Registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paddock.llm import alignment, centroids, decontamination, embeddings, fingerprints, language, licenses, minhash, packing, quality, sharding, substrings, suffixes
from paddock.llm.common import table


#: files of public tokenizers, by their names in the installed collection
TOKENIZER, BYTE_LEVEL, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _aligned(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return alignment.report(docs, tokenizer(BYTE_LEVEL), tokenizer(PIECES), public_tokenizers.PATTERN)


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": lambda spark, sf_dir: decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_sharding": _documents(sharding.sharded),
    "op3_quality": lambda spark, sf_dir: quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_language": _documents(language.report),
    "op5_suffixes": _documents(suffixes.report),
    "op6_licenses": _documents(licenses.report),
    "op7_embeddings": lambda spark, sf_dir: embeddings.report(table(spark, sf_dir, "embeddings")),
    "op8_substrings": _documents(substrings.report),
    "op9_packing": _documents(lambda docs: packing.packed(docs, tokenizer())),
    "op10_minhash": _documents(minhash.report),
    "op11_centroids": lambda spark, sf_dir: centroids.clusters(table(spark, sf_dir, "embeddings")),
    "op12_alignment": _documents(_aligned),
    "op13_fingerprints": _documents(fingerprints.report),
}

SQL: dict[str, str] = {
    "op1_decontamination": decontamination.SQL,
    "op5_suffixes": suffixes.SQL,
    "op8_substrings": substrings.SQL,
    "op11_centroids": centroids.SQL,
}
