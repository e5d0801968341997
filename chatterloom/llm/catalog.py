"""All queries of this package; importing a module registers its query."""

from chatterloom.llm import q_clustering, q_conversations, q_decontaminate, q_fingerprints, q_langid, q_mixing, q_near_dups, q_pii, q_quality, q_secrets, q_top_k, q_toxicity, q_warc  # noqa: F401
from chatterloom.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
