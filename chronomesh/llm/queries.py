"""All queries of this subpackage."""

from chronomesh.llm import (  # noqa: F401
    queries_bpe, queries_chat, queries_decontaminate, queries_katz, queries_langid, queries_merkle, queries_pii, queries_quality,
    queries_secrets, queries_simhash, queries_toxicity, queries_url, queries_whiten,
)
from chronomesh.llm.registry import CHECKS, QUERIES  # noqa: F401
