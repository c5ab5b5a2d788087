"""Column functions on identifiers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed from identifiers: the ASCII controls, no-break space and the Unicode spaces.
SPACES = " \t\n\r\x0b\x0c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def squeeze(col: Column | str) -> Column:
    """Strip white space of any kind from both ends; NULL stays NULL."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(SPACES))


def id_key(col: Column | str) -> Column:
    """Comparison form of an identifier: trimmed, in lower case."""
    return F.lower(squeeze(col))


def blank(col: Column | str) -> Column:
    """True where a text is NULL or only white space."""
    return F.coalesce(squeeze(col) == "", F.lit(True))


def opaque(col: Column) -> Column:
    """Keep the optimizer from copying a long expression into every filter above it.

    A filter is not pushed through a projection that is not deterministic; the condition
    itself always holds.
    """
    return F.when(F.spark_partition_id() >= 0, col)
