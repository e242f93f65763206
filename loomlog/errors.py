"""Errors of queries, schemas and transactions."""


class DatalogError(ValueError):
    """Something asked for can't be: the message says what."""
