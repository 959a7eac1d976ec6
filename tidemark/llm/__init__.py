"""Operators on text corpora for language models. Nothing outside imports this subpackage."""
