"""Queries of the core, by name. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.hierarchy import hierarchy
from .operators.multivalue import explode_values, packed_numbers, packed_values
from .operators.orphans import orphan_counts, orphan_references, references, registrations
from .session import table


def _p1_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dep, fun = table(spark, d, "dependson"), table(spark, d, "component_functions")
    refs = (
        references(dep, "dependson", "component", "loaded_at")
        .unionByName(references(dep, "dependson", "depends_on", "loaded_at"))
        .unionByName(references(fun, "component_functions", "component", "loaded_at"))
    )
    return refs, registrations(table(spark, d, "components"), "component", "registered_at", "removed_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*_p1_inputs(spark, d)).select("ref_table", "ref_field", "row_id")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    out = orphan_counts(*_p1_inputs(spark, d))
    return out.select("ref_table", "ref_field", F.date_format("period", "yyyy-MM").alias("period"), "n_refs", "n_orphans")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "subfunction"), "sub_function_of", "function_name").found()


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of each name, from its root (or from the loop's node it hangs on) down to itself."""
    return hierarchy(table(spark, d, "subfunction"), "sub_function_of", "function_name").paths()


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """For each name the interval of a chain, or the loop, that has all names below it in ``p4_members``."""
    return hierarchy(table(spark, d, "subfunction"), "sub_function_of", "function_name").intervals()


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each name's places on the chains and the loop it lies on or below."""
    return hierarchy(table(spark, d, "subfunction"), "sub_function_of", "function_name").members()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log, ext = table(spark, d, "aircraft_annotation_datafile"), table(spark, d, "problem_extractions_regex")
    return (
        explode_values(log, "aircraft_annotation_datafile", "part", packed_values(F.col("part")))
        .unionByName(explode_values(log, "aircraft_annotation_datafile", "location", packed_values(F.col("location"))))
        .unionByName(explode_values(ext, "problem_extractions_regex", "cylinders", packed_numbers(F.col("cylinders"))))
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_counts": p1_orphan_counts,
    "p4_found": p4_found,
    "p4_paths": p4_paths,
    "p4_descendants": p4_descendants,
    "p4_members": p4_members,
    "p5_found": p5_found,
}
