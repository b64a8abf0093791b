"""Structured records from log lines by regular expressions; all JVM expressions, no shuffle but the head count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import number_rows

# The grammars of problems and actions, and what is taken off a location.
PLACE = r"(?:(?:L|R)/H ?(?:REAR )?(?:AFT )?(?:ENG(?:INE)?,? ?)?)?(?:CYL(?:INDER)? ?)?(?:ALL )?(?:#?\d(?: ?. \d)*)?(?: CYL(?:INDER)? ?)?"
PROBLEM = (
    rf"^({PLACE})? ?(\w[ \w]+?)S?,? (?:ON )?({PLACE})? ?(?:IS |ARE |HAS |HAVE |APPEARS TO BE )?(?:A )?(?:POSSIBLE )?"
    r"(?:EVIDENCE OF )?(?:COMING )?(?:SEVERAL )?(?:SHOWS SIGNS OF )?"
    r"((?:OIL )?LEAK(?:ING)?S?|LOOSE|TORN|CRACKED|BROKEN|DAMAGED?|WORN|MISSING|BAD|SHEAR(?:ED)?|BROKE|STUCK|STICK(?:ING)?|DIRTY|DEAD|FAILED|NEEDS?|.*COMPRESSION.*)"
    rf",? ?(?:ON )?({PLACE})? ?(.*)"
)
ACTION = (
    r"^(?:REMOVED & )?(?:RE)?(REPLACED|TIGHTENED|SECURED|ATTACHED|FASTENED|TORQUED|CLEANED|STOP DRILLED) ?"
    r"((?:(?:L|R)/H (?:ENG )?)?(?:CYL ?)?(?:#?\d(?: ?. \d)*)(?: CYL ?)?)? ?(?:W/ )?(?:NEW )?([^,.]*?\w)S?(?: W/ .*)?(?:[,.] .*)?$"
)
PLACE_WORDS = ("CYLINDER", "ENGINE", "CYL", "ENG", "#", ",", "&", "(", ")")
ALL_CYLINDERS = "1 2 3 4"

#: Unicode classes, only \n ends a line, no case.
_FLAGS = "(?Uid)"


def clean_log(c: Column, compat_nan: bool = False) -> Column:
    """Dots and then white space off both ends; null stays null, or becomes nan with ``compat_nan``."""
    s = F.regexp_replace(F.regexp_replace(c, r"\A\.+|\.+\z", ""), r"(?U)\A\s+|\s+\z", "")
    return F.coalesce(s, F.lit("nan")) if compat_nan else s


def _groups(c: Column, pattern: str, names: tuple[str, ...]) -> list[Column]:
    rx = _FLAGS + pattern
    hit = c.rlike(rx)
    return [F.when(hit, F.regexp_extract(c, rx, i)).alias(n) for i, n in enumerate(names, 1)]


def problem_groups(c: Column) -> list[Column]:
    """loc1, part, loc2, problem, loc3, rest of a problem line; all null where it does not match."""
    return _groups(c, PROBLEM, ("loc1", "part", "loc2", "problem", "loc3", "rest"))


def action_groups(c: Column) -> list[Column]:
    """action, location, part of an action line; all null where it does not match."""
    return _groups(c, ACTION, ("action", "location", "part"))


def join_locations(*cols: Column) -> Column:
    """Filled fragments with their own spacing, joined by a blank."""
    return F.concat_ws(" ", *[F.when(F.trim(c) != "", c) for c in cols])


def clean_location(c: Column) -> Column:
    """A location without its fixed words (case counts), ALL spelt out; null if nothing is left."""
    s = c
    for w in PLACE_WORDS:
        s = F.replace(s, F.lit(w), F.lit(""))
    s = F.trim(F.regexp_replace(F.replace(s, F.lit("ALL"), F.lit(ALL_CYLINDERS)), r"(?U)\s+", " "))
    return F.when(s != "", s)


def cylinder_digits(c: Column) -> Column:
    """Distinct digits in order, joined by a blank; null if there are none."""
    d = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d)"), 1))), " ")
    return F.when(d != "", d)


def engine_place(c: Column) -> Column:
    s = F.trim(F.regexp_replace(c, r"\d", ""))
    return F.when(s != "", s)


def head_token(c: Column) -> Column:
    t = F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " ")
    h = F.element_at(t, -1)
    return F.when(h != "", h)


def head_whitelist(parts: DataFrame, classes: DataFrame, part: str = "part", cls: str = "Part", tail: int = 50) -> DataFrame:
    """(head): the class names and the ``tail`` most frequent last words that are none; ties by the word."""
    known = classes.select(F.col(cls).alias("head")).dropna().distinct()
    counts = parts.select(head_token(F.col(part)).alias("head")).dropna().groupBy("head").count()
    rest = counts.join(known, "head", "left_anti").orderBy(F.desc("count"), "head").limit(tail).select("head")
    return known.unionByName(rest)


def filter_parts(df: DataFrame, whitelist: DataFrame, part: str = "part") -> DataFrame:
    """``df`` with null for parts whose last word is not listed. The list has a bound: the classes and the tail."""
    ok = F.broadcast(whitelist.select(F.col("head").alias("_h"), F.lit(True).alias("_ok")).distinct())
    return df.withColumn("_h", head_token(F.col(part))).join(ok, "_h", "left").withColumn(part, F.when(F.col("_ok"), F.col(part))).drop("_h", "_ok")


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def extract_problems(logs: DataFrame, classes: DataFrame, tail: int = 50, with_rest: bool = True, ident: str = "ident", text: str = "problem", compat_nan: bool = False) -> DataFrame:
    """id, part, problem, rest, cylinders, engine of each log line; what is missing is an empty string."""
    rows = logs.select(F.col(ident).cast("string").alias("id"), clean_log(F.col(text), compat_nan).alias("t"))
    g = rows.select("id", *problem_groups(F.col("t")))
    loc = clean_location(join_locations(F.col("loc1"), F.col("loc2"), F.col("loc3")))
    g = g.select("id", F.upper("part").alias("part"), "problem", (F.col("rest") if with_rest else F.lit("")).alias("rest"), loc.alias("loc"))
    g = g.withColumn("cylinders", cylinder_digits(F.col("loc"))).withColumn("engine", engine_place(F.col("loc")))
    return _finish(filter_parts(g, head_whitelist(g, classes, tail=tail)), ["id", "part", "problem", "rest", "cylinders", "engine"])


def extract_actions(logs: DataFrame, classes: DataFrame, tail: int = 50, ident: str = "ident", text: str = "action", compat_nan: bool = False) -> DataFrame:
    """id, action, part, cylinders, engine of each log line."""
    rows = logs.select(F.col(ident).cast("string").alias("id"), clean_log(F.col(text), compat_nan).alias("t"))
    g = rows.select("id", *action_groups(F.col("t")))
    g = g.select("id", "action", F.upper("part").alias("part"), clean_location(F.col("location")).alias("loc"))
    g = g.withColumn("cylinders", cylinder_digits(F.col("loc"))).withColumn("engine", engine_place(F.col("loc")))
    return _finish(filter_parts(g, head_whitelist(g, classes, tail=tail)), ["id", "action", "part", "cylinders", "engine"])


def label_values(c: Column) -> Column:
    """Values of an annotation: split at semicolons if there are any, else at commas; trimmed, filled ones only."""
    v = F.when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(v, lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: (x != "") & ~F.lower(x).isin("none", "nan"))


def batches(df: DataFrame, order: str, size: int = 20) -> DataFrame:
    """(batch, rows): fixed batches of the rows in an order, numbered from 0."""
    numbered = number_rows(df, order).withColumn("_n", F.col("row_no") - 1)
    row = F.struct("_n", *df.columns)
    out = numbered.groupBy(F.floor(F.col("_n") / size).cast("bigint").alias("batch")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # ``size`` rows
    return out.select("batch", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in df.columns])).alias("rows"))
