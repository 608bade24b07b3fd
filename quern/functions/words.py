"""Words and white space as column expressions, evaluated in the JVM.

White space is the Unicode property White_Space (no-break spaces included), punctuation is the
Unicode category P. Words are the runs of other characters, in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\p{P}\p{IsWhite_Space}]+"
EDGE_SPACE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; NULL stays NULL."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def words(c: Column) -> Column:
    """The words of a text in order; an empty array for NULL, empty or wordless texts."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORD_BREAK), lambda w: w != "")


def blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return c.isNull() | (strip(c) == "")
