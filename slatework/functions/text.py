"""Text expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks and invisible characters at the ends of an entry. Trimmed as a set of characters: no pattern is matched per row.
BLANK = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u034f"


def bare(c: Column) -> Column:
    """Without blanks and invisible characters at either end."""
    return F.btrim(c, F.lit(BLANK))


def is_blank(c: Column) -> Column:
    """Null, empty or only blanks."""
    return F.coalesce(bare(c) == "", F.lit(True))
