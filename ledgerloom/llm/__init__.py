"""Corpus-preparation operators for language-model training data.

Every module holds one operator with a general DataFrame interface; `queries`
holds the thin `opN_<name>` queries that apply them to the synthetic tables.
Nothing outside this subpackage imports it.
"""
