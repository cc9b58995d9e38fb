"""Operators for preparing large text corpora for language-model training.

One module per operator; ``catalog`` registers the queries. Nothing else in
the library imports this subpackage.
"""
