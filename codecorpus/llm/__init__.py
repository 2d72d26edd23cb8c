"""Operators for building training data from a document corpus.

Nothing else in the library imports this subpackage.  ``queries`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains
some of them.
"""
