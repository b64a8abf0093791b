"""References to records that do not exist, per table and period, robust against hot keys.

A registration covers a name from ``start`` (inclusive) to ``end`` (exclusive, null: open). A reference
is an orphan when no registration of its name covers its time. Method: skew-aware split.

1. References are pre-aggregated per key and day (the period), registrations likewise; a key's day rows
   are bounded by the calendar, not by the data, so the running maximum of the registrations' ends over
   a key's days is a small window whatever the skew.
2. The verdict of a (key, day) is the end carried over from earlier days, and whether registrations start
   on that very day. It decides every reference of the day at once, except on days on which coverage
   changes; only there rows are compared one by one, in an anti-join per (key, day).
3. Keys holding more than a fixed share of the references are heavy: there are fewer than 1 / share, so
   their verdicts have a proven bound, are counted, and are broadcast; above the limit they are salted
   instead. All other keys go through a shuffle join. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_filled, name_key, squeeze
from ..session import cut, cut_count
from .skew import HEAVY_FLOOR, HEAVY_SHARE, heavy_keys, is_heavy, skew_join

#: End of an open registration.
OPEN_END = "9999-12-31 00:00:00"
#: Day of references without a time: before every registration.
NO_DAY = "0001-01-01"
#: Most verdict rows of heavy keys that are broadcast (about 30 bytes each); beyond it they are salted.
BROADCAST_ROWS = 200_000
SALTS = 32


def references(df: DataFrame, ref_table: str, ref_field: str, at: str, row_id: str = "row_id") -> DataFrame:
    """(ref_table, ref_field, row_id, key, at, day) of the non-blank references in one column."""
    return (
        df.filter(is_filled(F.col(ref_field)))  # on the name itself, so its key is worked out once
        .select(
            F.lit(ref_table).alias("ref_table"),
            F.lit(ref_field).alias("ref_field"),
            F.col(row_id).cast("bigint").alias("row_id"),
            F.lower(squeeze(F.col(ref_field))).alias("key"),
            F.col(at).alias("at"),
        )
        .withColumn("day", F.coalesce(F.to_date("at"), F.lit(NO_DAY).cast("date")))
    )


def registrations(df: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """(key, start, end, day) of the distinct registrations that cover any time at all."""
    return (
        df.select(
            name_key(F.col(name)).alias("key"),
            F.col(start).alias("start"),
            F.coalesce(F.col(end), F.lit(OPEN_END).cast("timestamp_ntz").cast(df.schema[end].dataType)).alias("end"),
        )
        .filter(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("start") < F.col("end")))
        .distinct()
        .withColumn("day", F.to_date("start"))
    )


def day_verdicts(key_days: DataFrame, reg: DataFrame) -> DataFrame:
    """(key, day, carry, same_day) for each referenced (key, day).

    ``carry`` is the latest end among registrations that start on an earlier day (null: none).
    """
    reg_days = reg.groupBy("key", "day").agg(F.max("end").alias("day_end"))
    both = (
        key_days.select("key", "day", F.lit(True).alias("asked"))
        .unionByName(reg_days, allowMissingColumns=True)
        .groupBy("key", "day")
        .agg(F.max("asked").alias("asked"), F.max("day_end").alias("day_end"))
    )
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return both.select("key", "day", "asked", F.max("day_end").over(before).alias("carry"), F.col("day_end").isNotNull().alias("same_day")).filter("asked").drop("asked")


def _undecided(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("carry").isNull() | F.col("at").isNull() | (F.col("at") >= F.col("carry")))


def _settle(rows: DataFrame, reg: DataFrame, small_reg: bool = False, on: tuple[str, ...] = ("key", "day")) -> DataFrame:
    """Rows that no earlier day's registration covers, less those covered by one of the same day.

    ``on``: the columns both sides share, besides the key and day the salt where they are salted.
    """
    rows = _undecided(rows)
    same = reg.select(*[F.col(c).alias(f"_{c}") for c in on], "start", "end")
    hit = (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end"))
    for c in on:
        hit = hit & (F.col(c) == F.col(f"_{c}"))
    left = rows.filter(F.col("same_day")).join(F.broadcast(same) if small_reg else same, hit, "left_anti")
    return rows.filter(~F.col("same_day")).unionByName(left)


def orphan_references(refs: DataFrame, reg: DataFrame, share: float = HEAVY_SHARE, floor: int = HEAVY_FLOOR, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``refs`` (see ``references``) that no row of ``reg`` (see ``registrations``) covers.

    Blank names are no references. A reference without a time is an orphan. Registrations without a start,
    or ending no later than they start, cover nothing. Repeated references each count. An empty register
    makes every reference an orphan; empty references give no rows.
    """
    keep = ["ref_table", "ref_field", "row_id", "key", "at", "day"]
    refs = cut(refs.select(*keep))  # read by every branch below; the keys are worked out once
    per_day = cut(refs.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n")))
    reg = cut(reg)
    heavy = heavy_keys(per_day, ["key"], "n", share, floor)
    hot = is_heavy(["key"], heavy)

    light = day_verdicts(per_day.filter(~hot), reg.filter(~hot))
    out = _settle(refs.filter(~hot).join(light, ["key", "day"]), reg.filter(~hot)).select(*keep)
    if not heavy:
        return out
    hot_reg = reg.filter(hot)
    verdict, size = cut_count(day_verdicts(per_day.filter(hot), hot_reg))
    size += hot_reg.count()
    if size <= broadcast_rows:
        rows = refs.filter(hot).join(F.broadcast(verdict), ["key", "day"])
        return out.unionByName(_settle(rows, hot_reg, True).select(*keep))
    # too many verdicts to broadcast: both joins are salted, and the few sides that are not references are repeated
    on = ("key", "day", "salt")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rows = refs.filter(hot).withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_table", "ref_field"), F.lit(SALTS)).cast("int"))
    rows = rows.join(verdict.withColumn("salt", spread), list(on))
    return out.unionByName(_settle(rows, hot_reg.withColumn("salt", spread), on=on).select(*keep))


def orphan_counts(refs: DataFrame, reg: DataFrame, **kw) -> DataFrame:
    """(ref_table, ref_field, period, n_refs, n_orphans) per table, field and month.

    Whole (key, day) groups are decided by their verdict; only groups in which coverage changes are
    resolved row by row. ``period`` is null for references without a time.
    """
    on = ["ref_table", "ref_field", "key", "day"]
    refs = cut(refs)
    groups = cut(
        refs.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("at").alias("timed"))
    )
    judged = groups.join(day_verdicts(groups.select("key", "day").distinct(), reg), ["key", "day"])
    all_out = ~F.col("same_day") & (F.col("carry").isNull() | (F.col("timed") == 0) | (F.col("first") >= F.col("carry")))
    all_in = F.coalesce(F.col("last") < F.col("carry"), F.lit(False))
    period = F.when(F.col("day") != F.lit(NO_DAY).cast("date"), F.trunc("day", "month")).alias("period")
    decided = judged.filter(all_out | all_in).select("ref_table", "ref_field", period, "n", F.when(all_out, F.col("n")).otherwise(F.lit(0)).alias("o"))
    open_days = judged.filter(~(all_out | all_in))
    rest = open_days.select("ref_table", "ref_field", period, "n", F.lit(0).cast("bigint").alias("o"))
    # one row a group on the right, so hot groups are spared the shuffle
    heavy = heavy_keys(groups, on, "n", kw.get("share", HEAVY_SHARE), kw.get("floor", HEAVY_FLOOR))
    rows = orphan_references(skew_join(refs, open_days.select(*on), on, heavy, "left_semi"), reg, **kw)
    rows = rows.select("ref_table", "ref_field", period, F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("o"))
    return decided.unionByName(rest).unionByName(rows).groupBy("ref_table", "ref_field", "period").agg(F.sum("n").cast("bigint").alias("n_refs"), F.sum("o").cast("bigint").alias("n_orphans"))
