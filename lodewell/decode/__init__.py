"""Pure decoders of on-disk structures: bytes in, plain Python values out, no Spark.

Every decoder takes hostile bytes: it returns an error value or raises
``Damage`` with a reason, and never reads outside its buffer.
"""

from __future__ import annotations


class Damage(ValueError):
    """A structure that can't be what it is said to be; the message says why."""
