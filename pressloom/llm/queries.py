"""One query for each operator, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontamination, language_id, merkle, near_dedup, packing, phrase_dedup, quality_classifier, quality_rules, sharding, sql, suffix_dedup, token_counts, url_filter
from .tables import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed public tokenizer lies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": lambda s, d: sharding.interleaved(read(s, d, "documents")),
        "op2_near_dedup": lambda s, d: near_dedup.components(read(s, d, "documents")),
        "op3_url_filter": lambda s, d: url_filter.judge(read(s, d, "pages")),
        "op4_quality_rules": lambda s, d: quality_rules.judge(read(s, d, "documents")),
        "op5_phrase_dedup": lambda s, d: phrase_dedup.digests(read(s, d, "documents")),
        "op6_decontamination": lambda s, d: decontamination.report(read(s, d, "documents"), read(s, d, "benchmark")),
        "op7_token_counts": lambda s, d: token_counts.histogram(read(s, d, "documents"), tokenizer_path()),
        "op8_suffix_dedup": lambda s, d: suffix_dedup.digests(read(s, d, "documents"), words=suffix_dedup.PASSAGE),
        "op9_packing": lambda s, d: packing.pieces(read(s, d, "documents"), tokenizer_path()),
        "op10_quality_classifier": lambda s, d: quality_classifier.select(read(s, d, "documents"), read(s, d, "labels")),
        "op11_merkle_manifest": lambda s, d: merkle.verified(read(s, d, "documents")),
        "op12_language_id": lambda s, d: language_id.report(read(s, d, "documents")),
        "op13_conversation_trie": lambda s, d: conversation_trie.trie(read(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
