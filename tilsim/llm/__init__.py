"""Training-data operators: cleaning, de-duplication, scoring and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
