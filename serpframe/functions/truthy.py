"""The "first truthy value" rule as Spark column expressions.

``a or b or c`` skips None, '', 0, empty lists and empty maps, and returns
its last operand when every operand is falsy (so the last one is not
nulled). ``coalesce`` alone only skips nulls, hence one helper per type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_str(*cols) -> Column:
    """String chain: blank strings count as missing except in last place."""
    cs = [_col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def first_num(*cols) -> Column:
    """Number chain: zero counts as missing except in last place."""
    cs = [_col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs[:-1]], cs[-1])


def first_number_text(*cols) -> Column:
    """Chain over texts of JSON numbers: ``0`` (also ``0.0``, ``-0``) and blanks count as missing, but in last place.

    A number reaches a text column as its JSON text, so the number 0 and the
    text "0" look alike; both are taken as the number.
    """
    cs = [_col(c) for c in cols]
    return F.coalesce(*[F.when(~c.rlike(r"^(?:-?0+(?:\.0*)?(?:[eE][+-]?[0-9]+)?)?$"), c) for c in cs[:-1]], cs[-1])


def first_nonempty(*cols) -> Column:
    """Array or map chain: empty collections count as missing."""
    cs = [_col(c) for c in cols]
    out = cs[-1]
    for c in reversed(cs[:-1]):
        out = F.when(F.size(c) > 0, c).otherwise(out)
    return out


def let(value, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a bound variable.

    Column functions that use their input several times would otherwise
    copy the whole input expression into every use, and nested functions
    multiply the copies. Binding through a one-element ``transform`` keeps
    the expression tree linear in the nesting depth.
    """
    return F.try_element_at(F.transform(F.array(_col(value)), fn), F.lit(1))
