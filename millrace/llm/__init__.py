"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it; its queries and SQL live in ``millrace.llm.queries``.
"""
