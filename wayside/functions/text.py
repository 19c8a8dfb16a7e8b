"""String columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# fixed values: the white space characters of Unicode
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(col) -> Column:
    """Strip every kind of leading and trailing white space."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def non_blank(col) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trimmed(col), F.lit(""))


def ascii_lower(col) -> Column:
    """Fold A-Z only; other scripts keep their case."""
    return F.translate(col, _UPPER, _UPPER.lower())


def same_ascii(left, right) -> Column:
    """ASCII case-insensitive equality; null when a side is null."""
    return ascii_lower(left) == ascii_lower(right)


def truthy(cond: Column) -> Column:
    """Collapse three-valued logic: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def slug(col) -> Column:
    """ASCII letters and digits in lower case, all else runs of one underscore."""
    folded = F.regexp_replace(ascii_lower(col), "[^0-9a-z]+", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def stable_id(prefix: str, col) -> Column:
    body = slug(F.coalesce(col, F.lit("")))
    return F.when(body == "", F.lit(f"{prefix}_unknown")).otherwise(F.concat(F.lit(f"{prefix}_"), body))


def user_hash(salt: str, col) -> Column:
    """sha256 over salt, NUL and the user id, as lower-case hex."""
    return F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), col).cast("binary"), 256)
