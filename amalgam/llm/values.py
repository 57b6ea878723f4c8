"""Values that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that nothing is known (lower case, trimmed).
MISSING = ("", "?", "??", "-", "--", "---", ".", "n/a", "n.a.", "none", "null", "nan", "nil", "unknown", "not given", "not known", "not available", "tbc", "tbd")

BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2002\u2003\u2004\u2005\u2007\u2009\u200b\u202f\u3000\ufeff"


def is_missing(c: Column) -> Column:
    """Null, blank or one of MISSING. NA isn't: it is a country."""
    return c.isNull() | F.lower(F.trim(c, F.lit(BLANKS))).isin(*MISSING)
