"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it; it can be deleted with ``tests/llm``.
"""
