"""Number coercion from loosely typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serpframe.functions.text import strip
from serpframe.functions.truthy import _col, let

# Text Python's float() accepts, without the digit-group underscores
# (``1_000`` gives null here, a documented deviation) and without the
# spelled-out infinities and NaN, which never become an integer anyway.
FLOAT_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def coerce_int(c) -> Column:
    """Trim, parse as a float, truncate toward zero; blank or junk gives null."""
    return let(strip(_col(c).cast("string")),
               lambda s: F.when(s.rlike(FLOAT_TEXT), s.try_cast("double").try_cast("bigint")))


def int_text(c) -> Column:
    """Integer value of text Python's ``int()`` accepts, else null."""
    return let(strip(_col(c).cast("string")), lambda s: F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")))
