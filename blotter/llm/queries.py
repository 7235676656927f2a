"""All corpus queries; importing this module registers them."""

from blotter.llm import query_ann, query_bpe, query_decontaminate, query_langid, query_lexical, query_licenses, query_phrases, query_secrets, query_simhash, query_spans, query_substrings, query_tokencount, query_warc  # noqa: F401
from blotter.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
