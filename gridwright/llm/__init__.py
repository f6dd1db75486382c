"""Operators for training-data corpora: one module per operator, ``queries.py`` registers them."""
