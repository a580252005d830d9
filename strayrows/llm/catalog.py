"""All queries of the subpackage."""

from strayrows.llm import bpe, conversation_repair, exact_dedup, language_id, line_dedup, ngram_join, packing, quality_rules, secret_scan, substring_dedup, toxicity, warc, whitening  # noqa: F401
from strayrows.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
