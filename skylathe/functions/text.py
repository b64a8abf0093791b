"""Text expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space.
SPACE = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """Trim and make each run of white space one blank; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_filled(c: Column) -> Column:
    """Neither null nor only white space."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def name_key(c: Column) -> Column:
    """Names that differ only in letter case or white space get one key; blank ones get null."""
    return F.when(is_filled(c), F.lower(squeeze(c)))
