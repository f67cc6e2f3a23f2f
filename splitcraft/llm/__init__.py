"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Each module holds one operator with a general interface and, at its end, the
thin ``opN_...`` query that applies it with production parameters to the whole
table.  Nothing outside this folder imports it.
"""
