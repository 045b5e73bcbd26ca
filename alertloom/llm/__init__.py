"""Operators for building training data: dedup, filters, decontamination, tokenization, scoring.

Nothing else in the library imports this subpackage. :func:`load` gives the registered queries.
"""


def load():
    """The registry with every operator's query, and the pipeline."""
    from . import queries

    return queries
