"""Operators for building training corpora, on documents, pages and conversations.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
