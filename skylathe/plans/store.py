"""What a query reads: triples as a set, by predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class QuadStore:
    """Quads (g, s, p, o); queries see the distinct triples of the union of all graphs.

    With quads stored by ``save`` a pattern with a bound predicate reads that predicate's partition only.
    """

    def __init__(self, quads: DataFrame) -> None:
        self.quads = quads
        self.spark = quads.sparkSession

    def triples(self) -> DataFrame:
        return self.quads.select("s", "p", "o").distinct()

    def predicate(self, p: str) -> DataFrame:
        return self.quads.filter(F.col("p") == p).select("s", "o").distinct()

    def rows(self, p: str) -> DataFrame:
        """As ``predicate``, but triples may be repeated: for semi-joins, which do not mind."""
        return self.quads.filter(F.col("p") == p).select("s", "o")

    def graph(self, g: str | None = None) -> DataFrame:
        return self.quads.select("g", "s", "p", "o").distinct() if g is None else self.quads.filter(F.col("g") == g).select("s", "p", "o").distinct()

    def save(self, path: str) -> None:
        self.quads.repartition("p").write.mode("overwrite").partitionBy("p").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls(spark.read.parquet(path).select("g", "s", "p", "o"))


class MappedStore:
    """Triples computed from tables: a plan (s, o), or a function that makes it, for each predicate.

    A pattern with a bound predicate pulls in that predicate's plan only, so columns and tables that a query
    does not need are neither planned nor read.
    """

    def __init__(self, spark: SparkSession, plans: dict[str, DataFrame | Callable[[], DataFrame]], name: str = "<urn:mapped>") -> None:
        self.spark, self.plans, self.name = spark, plans, name
        self.made: dict[str, DataFrame] = {}

    def rows(self, p: str) -> DataFrame:
        """As ``predicate``, but triples may be repeated: for semi-joins, which do not mind."""
        if p not in self.plans:
            return self.spark.createDataFrame([], "s string, o string")
        if p not in self.made:
            plan = self.plans[p]
            self.made[p] = (plan if isinstance(plan, DataFrame) else plan()).select("s", "o")
        return self.made[p]

    def predicate(self, p: str) -> DataFrame:
        return self.rows(p).distinct()

    def triples(self) -> DataFrame:
        out = self.spark.createDataFrame([], "s string, p string, o string")
        for p in self.plans:
            out = out.unionByName(self.predicate(p).select("s", F.lit(p).alias("p"), "o"))
        return out

    def graph(self, g: str | None = None) -> DataFrame:
        t = self.triples()
        return t.select(F.lit(self.name).alias("g"), "s", "p", "o") if g is None else t.filter(F.lit(g == self.name))
