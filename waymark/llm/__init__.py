"""Operators for preparing text corpora for language-model training.

Nothing else in the library imports this package.  Each operator is a module with a
general function; :mod:`waymark.llm.queries` holds the thin ``opN_<name>`` queries.
"""
