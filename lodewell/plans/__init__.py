"""Query catalogue: the relational operators applied to tables, each with its SQL twin."""

from . import catalog, decoding

__all__ = ["catalog", "decoding"]
