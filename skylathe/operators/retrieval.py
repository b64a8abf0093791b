"""Neighbourhoods of seed nodes, and what they consist of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import BASE, is_bnode, is_iri, literal_py, text
from ..session import cut, cut_count

#: Most nodes that are broadcast.
BROADCAST_ROWS = 200_000


def seed_names(query: str, base: str = BASE) -> list[str]:
    """IRIs of all names after a colon in a query's text, of whatever prefix, in order."""
    return sorted({f"<{base}{m}>" for m in re.findall(r":([A-Za-z0-9_]+)", query)})


def seed_tokens(queries: DataFrame, question: str, text_col: str, base: str = BASE) -> DataFrame:
    """(question, seed) of many queries."""
    hits = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(":([A-Za-z0-9_]+)"), 1)))
    return queries.select(question, hits.alias("n")).select(question, F.concat(F.lit(f"<{base}"), F.col("n"), F.lit(">")).alias("seed"))


def literal_seeds(triples: DataFrame, query: str, base: str = BASE) -> DataFrame:
    """(seed): subjects with a property and literal that the query names."""
    pairs = re.findall(r':([A-Za-z0-9_]+)\s+"([^"]+)"', query)
    wanted = triples.sparkSession.createDataFrame([(f"<{base}{p}>", literal_py(v)) for p, v in pairs], "p string, o string")
    return triples.join(F.broadcast(wanted), ["p", "o"], "left_semi").filter(is_iri("s")).select(F.col("s").alias("seed")).distinct()


def khop(triples: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Distinct triples with an end at most ``depth`` steps from a seed, in either direction; only IRIs are walked on.

    No seeds: all triples. Depth 0 counts as 1. The triples are written down once, repeated ones included, as each round
    reads them; the frontier meets them in two joins and loses the nodes already visited. What is near is found in one
    pass and made distinct then, so the other triples are never shuffled unless what is near is too large to broadcast.
    """
    if not seeds.limit(1).count():
        return triples
    triples = cut(triples)
    visited = cut(seeds.select(F.col(seeds.columns[0]).alias("n")).distinct())
    frontier = visited
    for _ in range(max(1, depth)):
        out = triples.join(frontier.withColumnRenamed("n", "s"), "s", "left_semi").select(F.col("o").alias("n"))
        back = triples.join(frontier.withColumnRenamed("n", "o"), "o", "left_semi").select(F.col("s").alias("n"))
        frontier = cut(out.unionByName(back).filter(is_iri("n")).distinct().join(visited, "n", "left_anti"))
        visited = visited.unionByName(frontier)
    near, n = cut_count(visited)
    side = lambda c: (F.broadcast(near) if n <= BROADCAST_ROWS else near).select(F.col("n").alias(c), F.lit(True).alias(f"near_{c}"))
    return triples.join(side("s"), "s", "left").join(side("o"), "o", "left").filter("near_s or near_o").select(*triples.columns).distinct()


def term_type(c: str):
    return F.when(is_iri(c), "uri").when(is_bnode(c), "bnode").otherwise("literal")


def predicate_breakdown(triples: DataFrame, top: int = 10) -> DataFrame:
    """(predicate, count) of the most frequent predicates, and __other__ for the rest; ties by name."""
    counts = triples.groupBy("p").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "p"))  # one row a predicate
    named = counts.withColumn("r", rank).select(F.when(F.col("r") <= top, text("p")).otherwise("__other__").alias("predicate"), "count")
    return named.groupBy("predicate").agg(F.sum("count").cast("bigint").alias("count"))


def term_types(triples: DataFrame) -> DataFrame:
    """(position, term_type, count) of subjects and objects."""
    return triples.select(F.explode(F.array(*[F.struct(F.lit(n).alias("position"), term_type(c).alias("term_type")) for n, c in (("subject", "s"), ("object", "o"))])).alias("t")).groupBy("t.position", "t.term_type").agg(F.count(F.lit(1)).alias("count"))


def retrieval_text(seeds: list[str], depth: int | None, mode: str = "subgraph") -> str:
    """A readable form of what was retrieved."""
    if mode == "full":
        return "full_graph_serialisation"
    listed = ", ".join(sorted(s.strip("<>") for s in seeds)) or "UNSEEDED (full union graph)"
    return f"expand_subgraph(depth={depth}, seeds=[{listed}])"
