"""The maintenance tables as a graph: one plan of (s, o) for each predicate, for ``MappedStore``.

Each predicate is a projection of the table it comes from, so a query reads the columns it asks for. Names are
checked on the label itself, so a slug is worked out once for each row that is kept.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import BASE, has_name_sql, literal, slug_sql
from .operators.extraction import action_groups, clean_location, clean_log, cylinder_digits
from .plans.lift import DESCRIPTION, LABEL, SUBCLASS, TYPE, function_dependencies, log_index, name
from .plans.store import MappedStore
from .session import table


def _union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def _literal_sql(e: str, lang: str = "") -> str:
    esc = f"replace(replace(replace(replace(replace({e}, r'\\', r'\\\\'), '\"', r'\\\"'), '\\n', r'\\n'), '\\r', r'\\r'), '\\t', r'\\t')"
    return f"concat('\"', {esc}, '\"{lang}')"


class Maintenance:
    """Plans over the tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str, base: str = BASE) -> None:
        self.spark, self.d, self.base = spark, folder, base

    def t(self, name_: str) -> DataFrame:
        return table(self.spark, self.d, name_)

    def n(self, local: str) -> str:
        return f"'{name(local, self.base)}'"

    def node(self, e: str) -> str:
        """SQL of the IRI of a label that has a name."""
        return f"concat('<{self.base}', {slug_sql(e)}, '>')"

    def pairs(self, df: DataFrame, s: str, o: str, *labels: str, where: str = "true") -> DataFrame:
        """(s, o) by SQL, for the rows whose ``labels`` have a name."""
        return df.filter(" AND ".join([where, *map(has_name_sql, labels)])).selectExpr(f"{s} AS s", f"{o} AS o")

    @cached_property
    def logs(self) -> DataFrame:
        """The last log record of each identifier."""
        return log_index(self.t("aircraft_annotation_datafile").filter("ident IS NOT NULL").select("ident", "problem", "action", "row_id"))

    @cached_property
    def problems(self) -> DataFrame:
        """Extracted problem rows that have a log record."""
        known = self.t("aircraft_annotation_datafile").selectExpr("ident AS id").filter("id IS NOT NULL").distinct()
        return self.t("problem_extractions_regex").join(known, "id", "left_semi").selectExpr(f"concat('<{self.base}problem-', id, '>') AS ev", "id", "part", "problem", "cylinders")

    @cached_property
    def actions(self) -> DataFrame:
        """Actions read from the log records by the action grammar."""
        g = self.logs.select(F.col("ident").alias("id"), F.col("action").alias("log_text"), *action_groups(clean_log(F.col("action")))).filter("action IS NOT NULL")
        return g.withColumn("cylinders", cylinder_digits(clean_location(F.col("location")))).selectExpr(f"concat('<{self.base}action-', id, '>') AS ev", "id", "log_text", "action", "upper(part) AS part", "cylinders")

    @cached_property
    def problem_states(self) -> DataFrame:
        return self.problems.filter("trim(problem) <> ''").selectExpr("ev", "problem AS label", self.node("concat(problem, ' problem')") + " AS state")

    @cached_property
    def action_states(self) -> DataFrame:
        return self.actions.filter("trim(action) <> ''").selectExpr("ev", "action AS label", self.node("concat(action, ' action')") + " AS state")

    def type(self) -> DataFrame:
        cat, can, fun, sub = (self.t(x) for x in ("parts_catalog", "canonical_items", "component_functions", "subfunction"))
        is_a = lambda df, c, cls: self.pairs(df, self.node(c), self.n(cls), c)
        return _union(
            self.problems.selectExpr("ev AS s", f"{self.n('Problem')} AS o"),
            self.problem_states.selectExpr("ev AS s", "state AS o"),
            self.actions.selectExpr("ev AS s", f"{self.n('Action')} AS o"),
            self.action_states.selectExpr("ev AS s", "state AS o"),
            is_a(cat, "section_name", "System"),
            is_a(cat, "figure", "Assembly"),
            is_a(fun, "has_function", "Function"),
            is_a(sub, "sub_function_of", "Function"),
            is_a(sub, "function_name", "Function"),
            is_a(self.t("components"), "component", "Component"),
            self.pairs(can, self.node("label"), self.node("element_at(split(label, ' '), -1)"), "label", where="list_name = 'part'"),
        )

    def label(self) -> DataFrame:
        cat, can, fun, sub = (self.t(x) for x in ("parts_catalog", "canonical_items", "component_functions", "subfunction"))
        own = lambda df, c: self.pairs(df, self.node(c), _literal_sql(c), c)
        states = self.problem_states.unionByName(self.action_states).selectExpr("state AS s", _literal_sql("label") + " AS o")
        kinds = can.filter("list_name = 'part'").selectExpr("element_at(split(label, ' '), -1) AS k")
        return _union(states, own(cat, "section_name"), own(cat, "figure"), own(fun, "has_function"), own(sub, "sub_function_of"), own(sub, "function_name"), own(kinds, "k"))

    def subclass(self) -> DataFrame:
        return self.problem_states.selectExpr("state AS s", f"{self.n('Problem')} AS o").unionByName(self.action_states.selectExpr("state AS s", f"{self.n('Action')} AS o"))

    def description(self) -> DataFrame:
        text = self.logs.selectExpr("ident AS id", "problem AS t")
        p = self.problems.select("ev", "id").distinct().join(text, "id").filter("t IS NOT NULL").select(F.col("ev").alias("s"), literal(F.col("t"), lang="en").alias("o"))
        return p.unionByName(self.actions.filter("log_text IS NOT NULL").select(F.col("ev").alias("s"), literal(F.col("log_text"), lang="en").alias("o")))

    def involves(self) -> DataFrame:
        return self.pairs(self.problems.select("ev", "part").unionByName(self.actions.select("ev", "part")), "ev", self.node("part"), "part")

    def at_location(self) -> DataFrame:
        rows = self.problems.select("ev", "cylinders").unionByName(self.actions.select("ev", "cylinders"))
        return rows.selectExpr("ev AS s", r"explode(array_distinct(regexp_extract_all(cylinders, r'(\d+)', 1))) AS d").selectExpr("s", f"concat('<{self.base}Cylinder', d, '>') AS o")

    def deals_with(self) -> DataFrame:
        return self.actions.selectExpr("ev AS s", f"concat('<{self.base}problem-', id, '>') AS o")

    def part_of(self) -> DataFrame:
        cat = self.t("parts_catalog")
        sys_, asm = self.node("section_name"), self.node("figure")
        own = "trim(part_number) <> ''"
        return _union(self.pairs(cat, asm, sys_, "figure", "section_name"), self.pairs(cat, self.part(), asm, "figure", where=own), self.pairs(cat, self.part(), sys_, "section_name", where=own))

    def part(self) -> str:
        return f"concat('<{self.base}partnr-', regexp_replace(part_number, r'\\s', '_'), '>')"

    def part_number(self) -> DataFrame:
        return self.pairs(self.t("parts_catalog"), self.part(), _literal_sql("part_number"), where="trim(part_number) <> ''")

    def has_function(self) -> DataFrame:
        return self.pairs(self.t("component_functions"), self.node("component"), self.node("has_function"), "component", "has_function")

    def component_dependencies(self) -> DataFrame:
        return self.pairs(self.t("dependson"), self.node("component"), self.node("depends_on"), "component", "depends_on").distinct()

    def depends_on(self) -> DataFrame:
        dep = self.component_dependencies()
        owns = self.has_function().selectExpr("s AS c", "o AS f").distinct()
        return dep.unionByName(function_dependencies(owns, dep.selectExpr("s AS a", "o AS b"), self.base).select("s", "o"))

    def sub_function_of(self) -> DataFrame:
        return self.pairs(self.t("subfunction"), self.node("function_name"), self.node("sub_function_of"), "function_name", "sub_function_of")

    def store(self) -> MappedStore:
        n = lambda x: name(x, self.base)
        return MappedStore(
            self.spark,
            {
                TYPE: self.type, LABEL: self.label, SUBCLASS: self.subclass, DESCRIPTION: self.description, n("involves"): self.involves,
                n("atLocation"): self.at_location, n("dealsWith"): self.deals_with, n("partOf"): self.part_of, n("partNumber"): self.part_number,
                n("hasFunction"): self.has_function, n("dependsOn"): self.depends_on, n("componentDependsOn"): self.component_dependencies, n("subFunctionOf"): self.sub_function_of,
            },
        )
