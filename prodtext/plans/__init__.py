"""Registered queries (import side effect fills the registry)."""

from prodtext.plans import annotation_queries, catalog_queries, corpus_queries, evaluation_queries, cleaning_queries, story_queries, file_queries, sentence_queries  # noqa: F401
from prodtext.plans.registry import ORACLE, QUERIES  # noqa: F401
