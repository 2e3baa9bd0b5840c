"""JSON text as a value: order of keys, spacing and escapes don't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """The value's one text: keys sorted, no spacing, no escapes. Text that isn't JSON stands for itself; null stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("\u0000"), text))


def digest(text: Column) -> Column:
    """128 bits that tell values apart; null text has a digest of its own."""
    return F.unhex(F.md5(F.coalesce(canonical(text), F.lit("\u0000null"))))
