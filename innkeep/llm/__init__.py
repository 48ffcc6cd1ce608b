"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this package; ``queries.py`` registers
one query per operator and ``corpus_pipeline.py`` at the repository top chains
five of them."""
