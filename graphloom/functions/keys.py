"""Key normalisation shared by the operators: column in, column out, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a strip removes: ASCII and Unicode white space.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(c, F.lit(BLANKS))


def key(c: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def pmid(c: Column) -> Column:
    """The digits of an article id written as ``123``, ``PMID:123`` or ``pmid: 123``; null if anything else."""
    bare = F.regexp_replace(strip(c), r"(?i)^pmid:\s*", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def edge_id(c: Column) -> Column:
    """An edge id without a leading ``edge:`` or ``edge_id:``; blank becomes null."""
    return F.nullif(strip(F.regexp_replace(strip(c), r"^(edge_id|edge):", "")), F.lit(""))
