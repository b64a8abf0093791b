"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .formatting import copies
from .mapping import Rules, map_values
from .packing import pack
from .terms import count_terms
from .tokenizer import token_counts, token_ids
from .truncation import truncated


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return count_terms(table(spark, d, "problem_extractions_regex"), ["part", "problem"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "aircraft_annotation_datafile"))[0]


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "aircraft_annotation_datafile"))[1]


#: Words of the trade that say where a part is or in what state, not what it is, and marks around names and numbers.
NAME = Rules(
    noise=frozenset("THE NEW OLD SPARE LEFT RIGHT LH RH L R H ENG ENGINE ASSY ASSEMBLY A AN OF".split()),
    edits=((r"\bS\s*/?\s*N\s*[:.#]?\s*\d+\b", " "), (r"#\s*\d+\s+CYL\b", " "), (r"\b([LR])\s*/\s*H\b", r"\1H")),
)
NUMBER = Rules(
    code=True,
    edits=((r"^\W*(?:P\s*/?\s*N\b[\s:.#-]*|P/?N(?=[A-Z]{2}\d|\d))", ""), (r"(?:\(\s*NEW\s*\)|\bREV\.?\s*[A-Z0-9]\b|[\s*])+$", "")),
    alike=("OISBZ", "01582"),
)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ext, cat = table(spark, d, "problem_extractions_regex"), table(spark, d, "parts_catalog")
    one = lambda df, name: df.select(F.lit(name).alias("field_name"), "row_id", F.col(name).alias("value"))
    values = one(ext, "part").unionByName(one(cat, "part_type")).unionByName(one(cat, "part_number"))
    return map_values(values, table(spark, d, "canonical_items"), {"part": NAME, "part_type": NAME, "part_number": NUMBER})


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each field have no entry, and how many have one."""
    found = p6_found(spark, d)
    return found.groupBy("field_name").agg(F.count_if(F.col("item_id") == 0).alias("n_unmatched"), F.count_if(F.col("item_id") != 0).alias("n_mapped"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")), "doc_id", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of the texts of each source that lack their end."""
    found = truncated(table(spark, d, "documents"))
    n, c = F.count(F.lit(1)), F.count_if("cut")
    return found.groupBy("source").agg(n.alias("n_texts"), c.alias("n_truncated"), F.round(c / n, 6).alias("share"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_copies": p3_copies, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_sources": p9_sources}

_SPACES = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS field_name, {f} AS raw, {_SPACES.format(c=f)} AS v FROM problem_extractions_regex" for f in ("part", "problem"))
_CANON = "list_sort(list_filter(list_transform(string_split(lower(coalesce({c}, '')), ';'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> ''))"
_CODED = f"""WITH c AS (SELECT row_id, array_to_string({_CANON.format(c='problem')}, ';') AS p, array_to_string({_CANON.format(c='action')}, ';') AS a FROM aircraft_annotation_datafile),
g AS (SELECT least(p, a) AS x, greatest(p, a) AS y, min(row_id) AS low, count(*) AS n FROM c WHERE p <> '' OR a <> '' GROUP BY ALL)"""

ORACLES = {
    "p2_found": f"""WITH r AS (SELECT row_number() OVER () AS id, field_name, raw, v FROM ({_VALUES}) WHERE v <> ''),
items AS (SELECT field_name, 'value' AS unit, upper(v) AS item, id FROM r
 UNION ALL SELECT field_name, 'term', upper(unnest(regexp_extract_all(raw, '[A-Za-z0-9]+'))), id FROM r),
n AS (SELECT field_name, unit, item, count(*) AS n_total, count(DISTINCT id) AS n_records FROM items GROUP BY ALL),
t AS (SELECT field_name, count(*) AS of FROM r GROUP BY 1)
SELECT n.*, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 20 > t.of THEN 'common' ELSE 'kept' END AS mark FROM n JOIN t USING (field_name)""",
    "p3_found": f"{_CODED} SELECT low AS row_id_a, row_id AS row_id_b FROM c JOIN g ON least(p, a) = x AND greatest(p, a) = y WHERE row_id <> low",
    "p3_copies": f"{_CODED} SELECT low AS row_id, n AS n_copies FROM g",
}
