"""Corpus-scale multilingual text processing as PySpark DataFrame operators."""
