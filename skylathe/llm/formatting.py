"""Records that differ only in formatting, by dictionary encoding.

Each distinct text is canonicalised once: only letters and digits, without case, fields between semicolons
sorted. Texts with one canonical form share an integer, records become sorted pairs of integers, and only
these are grouped. Blank texts need no dictionary: they are 0. Hot texts and hot groups are recognised by
their counts and joined by broadcast (``skew_join``), so no task gets all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HEAVY_FLOOR, heavy_keys, skew_join
from ..session import cut


def canonical_text(c: Column) -> Column:
    """Fields between semicolons, letters and digits only, in lower case, sorted; empty ones do not count.

    Null and texts without letter or digit give the empty string.
    """
    bare = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N};]+", ""))
    fields = F.filter(F.split(bare, ";"), lambda f: f != "")
    return F.array_join(F.array_sort(fields), ";")


def encode(df: DataFrame, row_id: str, texts: list[str], floor: int = HEAVY_FLOOR) -> DataFrame:
    """(row_id, codes): the sorted integers of each record's texts; records blank in all texts are left out."""
    # an array column and an explode read the table once; blank texts go before anything is shuffled. A text is sent
    # once, to be made distinct; everything else goes by 128 bits of its hash
    short = lambda c: F.unhex(F.md5(c))
    slots = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.explode(F.array(*[F.col(t) for t in texts])).alias("raw")).filter(F.col("raw").rlike(r"[\p{L}\p{N}]"))
    slots = slots.withColumn("key", short("raw"))
    raw = slots.groupBy("key").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"))
    words = cut(raw.select("key", "n", short(canonical_text(F.col("raw"))).alias("canon"), (F.monotonically_increasing_id() + 1).alias("id")))
    forms = words.groupBy("canon").agg(F.min("id").alias("code"), F.count(F.lit(1)).alias("n"))
    hot = heavy_keys(words.select("canon", F.lit(1).alias("n")), ["canon"], "n", floor=floor)
    codes = skew_join(words.select("key", "canon"), forms.drop("n"), ["canon"], hot, "inner").select("key", "code")
    coded = skew_join(slots.select("row_id", "key"), codes, ["key"], heavy_keys(words, ["key"], "n", floor=floor), "inner")
    tuples = coded.groupBy("row_id").agg(F.collect_list("code").alias("codes"))  # at most one code per text column
    return tuples.select("row_id", F.array_sort("codes").alias("codes"))


def copies(df: DataFrame, row_id: str = "row_id", texts: tuple[str, ...] = ("problem", "action"), floor: int = HEAVY_FLOOR) -> tuple[DataFrame, DataFrame]:
    """The pairs (row_id_a, row_id_b) of each group's smallest id with each other one, and the collapsed
    records (row_id, n_copies): one for each group, with the number of records it stands for.

    Records are equal if their texts are, in whatever order of the columns. A null text equals a blank one;
    records without letter or digit in all texts are left out of both. Row ids are unique; rows repeated
    under other ids are copies. An empty table gives no rows. Other columns, of whatever name, are not read.
    """
    records = cut(encode(df, row_id, list(texts), floor))
    groups = records.groupBy("codes").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = cut(groups.filter("n > 1"))
    hot = heavy_keys(several.select(F.to_json(F.struct("codes")).alias("k"), "n"), ["k"], "n", floor=floor)
    if hot:
        key = F.to_json(F.struct("codes"))
        is_hot = key.isin([h[0] for h in hot])
        a = records.filter(is_hot).join(F.broadcast(several.filter(is_hot)), "codes")
        b = records.filter(~is_hot).join(several.filter(~is_hot), "codes")
        joined = a.unionByName(b)
    else:
        joined = records.join(several, "codes")
    pairs = joined.filter(F.col("row_id") != F.col("first")).select(F.col("first").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
    return pairs, groups.select(F.col("first").alias("row_id"), F.col("n").alias("n_copies"))
