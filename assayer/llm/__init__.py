"""Training-data operators: scoring, matching, extraction, formatting and mixing of text corpora.

Nothing outside this package imports it.
"""
