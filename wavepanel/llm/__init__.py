"""Operators of a training-data pipeline over `documents`, `labels` and `embeddings`.

Each operator has a module of its own; `queries` registers one query per
operator.  Nothing else in the library imports this subpackage.
"""
