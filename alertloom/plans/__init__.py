"""The registered queries and the inputs they derive from the given tables."""


def load():
    """The registry with every query module imported."""
    from . import folds, registry, rows, statistics, tables  # noqa: F401

    return registry
