"""Several values packed in one field: one row per value with its position.

Method: quoted spans are cut out and replaced by indexed placeholders in private-use characters (any such
character already in the text is escaped first, so a placeholder cannot collide), the remaining separators
are split, the spans are put back by array lookup, and the array is exploded with positions. Everything is
a JVM expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A quote opens where no letter, digit or quote stands before it, so an inch mark (5/8") opens nothing.
QUOTED = r"""(?<![\w"])"(?:[^"]|"")*"(?![\w"])|(?<![\w'])'(?:[^']|'')*'(?![\w'])"""
# L/H, R/H and fractions are no separators.
SLASH = r"/(?<!(?<![A-Za-z0-9])[LRlr]/(?=[Hh](?![A-Za-z0-9])))(?<![0-9]/(?=[0-9]))"
SEPARATOR = rf"(?i)[;,|&+\t\r\n]|{SLASH}|(?<=\s)AND(?=\s)"
# In a field of numbers white space and every / part values too.
NUMBER_SEPARATOR = r"[;,|&+/\s]+"
# Words that mark numbers or stand between them, and are none themselves.
NUMBER_MARK = r"(?i)^(?:CYLINDERS?|CYLS?|NOS?|AND)?$"
NUMBER = r"(?i)^(?:CYLINDERS?|CYLS?|NOS?)?([0-9]+|ALL)$"
OPEN, SHUT, ESC = "\ue000", "\ue001", "\ue002"


def _escape(c: Column) -> Column:
    s = F.replace(c, F.lit(ESC), F.lit(ESC + "c"))
    s = F.replace(s, F.lit(OPEN), F.lit(ESC + "a"))
    s = F.replace(s, F.lit(SHUT), F.lit(ESC + "b"))
    return F.when(c.rlike(f"[{OPEN}{SHUT}{ESC}]"), s).otherwise(c)


def _restore(c: Column) -> Column:
    s = F.replace(c, F.lit(ESC + "a"), F.lit(OPEN))
    s = F.replace(s, F.lit(ESC + "b"), F.lit(SHUT))
    s = F.replace(s, F.lit(ESC + "c"), F.lit(ESC))
    return F.when(F.contains(c, F.lit(ESC)), s).otherwise(c)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unquote(span: Column) -> Column:
    mark = F.substring(span, 1, 1)
    return F.replace(F.substring(span, F.lit(2), F.length(span) - 2), F.concat(mark, mark), mark)


def packed_values(c: Column, separator: str = SEPARATOR) -> Column:
    """Array of the values in a field; null gives null, a field without values an empty array.

    Separators: ; , | & + tab, line end, the word AND, and / except in L/H, R/H and fractions. A separator
    inside quotes belongs to the value. Quotes around a value and brackets around the field go, a doubled
    quote inside is one quote. Empty pieces do not count, repeated values do. An unclosed quote is text.
    """
    text = _trim(_escape(c))
    text = F.when(text.rlike(r"(?s)^\[.*\]$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    # fields without quotes, the most, take the short way
    plain = F.split(text, separator)
    spans = F.regexp_extract_all(text, F.lit(QUOTED), 0)
    around = F.split(text, QUOTED, -1)
    marked = F.array_join(F.transform(around, lambda p, i: F.when(i < F.size(around) - 1, F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(SHUT))).otherwise(p)), "")

    def back(piece: Column) -> Column:
        whole = _trim(piece)
        parts = F.split(whole, f"[{OPEN}{SHUT}]", -1)  # text, index, text, index, ..., text
        alone = whole.rlike(f"^{OPEN}[0-9]+{SHUT}$")
        inside = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get(spans, p.try_cast("int"))).otherwise(p)), "")
        return F.when(alone, _unquote(F.get(spans, F.get(parts, F.lit(1)).try_cast("int")))).when(F.contains(whole, F.lit(OPEN)), inside).otherwise(whole)

    quoted = F.transform(F.split(marked, separator), back)
    raw = F.when(text.rlike("[\"']"), quoted).otherwise(F.transform(plain, _trim))
    return F.filter(F.transform(raw, lambda v: _trim(_restore(v))), lambda v: v != "")


def packed_numbers(c: Column) -> Column:
    """Array of the bare numbers (or ALL) in a field of cylinder numbers.

    Values are parted as in ``packed_values``, and by white space and every /; #, CYL, NO., quotes and brackets
    around a number go. A piece that is no number is kept as it is written, so nothing goes without a trace.
    """

    def bare(piece: Column) -> Column:
        return F.regexp_replace(piece, r"^[#()\[\]{}.:\"']+|[#()\[\]{}.:\"']+$", "")

    def number(piece: Column) -> Column:
        digits = F.regexp_extract(F.regexp_replace(piece, r"[#().:]", ""), NUMBER, 1)
        return F.when(digits != "", F.upper(digits)).otherwise(piece)

    pieces = F.filter(F.transform(packed_values(c, NUMBER_SEPARATOR), bare), lambda p: ~p.rlike(NUMBER_MARK))
    return F.transform(pieces, number)


def explode_values(df: DataFrame, table_name: str, field: str, values: Column, row_id: str = "row_id", least: int = 2) -> DataFrame:
    """(table_name, field_name, row_id, pos, item) of the fields that hold at least ``least`` values."""
    return (
        df.select(F.col(row_id).cast("bigint").alias("row_id"), values.alias("_v"))
        .filter(F.size("_v") >= least)
        .select(F.lit(table_name).alias("table_name"), F.lit(field).alias("field_name"), "row_id", F.posexplode("_v").alias("p", "item"))
        .select("table_name", "field_name", "row_id", (F.col("p") + 1).cast("bigint").alias("pos"), "item")
    )
