"""Operators that prepare training data for language models: packing, deduplication, quality, extraction, counting,
storage, mixing and search. Nothing else in the package imports this subpackage."""
