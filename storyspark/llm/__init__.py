"""Operations of a training-data pipeline: filters, near-duplicates, search, tokens, packing.

Nothing else in the library imports this subpackage.
"""
