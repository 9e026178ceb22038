"""All queries of this subpackage."""

from listwright.llm import byte_bpe, chat_format, embedding_dedup, exact_dedup, line_dedup, lm_scoring, near_dedup, packing, pieces, spelling, substring_dedup, toxicity, whitening  # noqa: F401
from listwright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
