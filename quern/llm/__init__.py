"""Operators for large-scale text corpora.

Nothing else in the library imports this subpackage; it may be deleted with
``tests/llm`` and ``corpus_pipeline.py`` without touching the rest.
"""
