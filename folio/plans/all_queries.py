"""Imports every module that registers queries."""

from folio.plans import catalog_queries, chapter_queries, document_queries, layout_queries, reading_queries, stream_queries, text_queries, usage_queries  # noqa: F401
