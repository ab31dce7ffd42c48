"""Operators for large training-data pipelines (chat pairs, filters, extraction, dedup,
archives, tokenising).  Nothing else in the library imports this subpackage; its queries
and their SQL are in :mod:`annualis.llm.queries`."""
