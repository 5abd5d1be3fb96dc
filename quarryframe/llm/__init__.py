"""Operators for preparing large text corpora.

Nothing outside this package imports it; its queries are registered through
``quarryframe.llm.queries``.
"""
