"""Operators that prepare text corpora for language-model training.

Each module holds one operator with its general interface; ``queries`` registers the thin
``opN_<name>`` queries. Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
