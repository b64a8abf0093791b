"""Checks of a graph against closed shapes: classes of values, number of values, properties that are not foreseen.

An extension: shapes are small tables, the checks are anti-joins and counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF, is_literal

TYPE = f"<{RDF}type>"


@dataclass
class Property:
    path: str
    cls: str | None = None  #: class of the values
    most: int | None = None  #: greatest number of values
    resource: bool = False  #: values are no literals


@dataclass
class Shape:
    target: str  #: class whose instances are checked
    properties: list[Property] = field(default_factory=list)
    closed: bool = False
    ignored: tuple[str, ...] = (TYPE,)


def violations(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(node, path, value, rule) of what does not fit; value is null for a count."""
    types = triples.filter(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls")).distinct()
    out = triples.sparkSession.createDataFrame([], "node string, path string, value string, rule string")
    for shape in shapes:
        nodes = types.filter(F.col("cls") == shape.target).select("node")
        own = triples.withColumnRenamed("s", "node").join(nodes, "node", "left_semi").select("node", F.col("p").alias("path"), F.col("o").alias("value"))
        for p in shape.properties:
            vals = own.filter(F.col("path") == p.path)
            if p.cls:
                right = types.filter(F.col("cls") == p.cls).select(F.col("node").alias("value"))
                out = out.unionByName(vals.join(right, "value", "left_anti").withColumn("rule", F.lit("class")))
            if p.resource:
                out = out.unionByName(vals.filter(is_literal("value")).withColumn("rule", F.lit("nodeKind")))
            if p.most is not None:
                many = vals.groupBy("node", "path").agg(F.count_distinct("value").alias("n")).filter(F.col("n") > p.most)
                out = out.unionByName(many.select("node", "path", F.lit(None).cast("string").alias("value"), F.lit("maxCount").alias("rule")))
        if shape.closed:
            known = [p.path for p in shape.properties] + list(shape.ignored)
            out = out.unionByName(own.filter(~F.col("path").isin(known)).withColumn("rule", F.lit("closed")))
    return out
