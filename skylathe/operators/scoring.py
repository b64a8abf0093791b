"""Answers compared with gold answers: canonical values, matches, precision, recall, F1 and their aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import RDFS, is_iri, local_name, match_key, text


def unique_labels(triples: DataFrame) -> DataFrame:
    """(key, iri): label keys that name one IRI only."""
    rows = triples.filter((F.col("p") == f"<{RDFS}label>") & is_iri("s")).select(match_key(text("o")).alias("key"), text("s").alias("iri"))
    return _single(rows)


def unique_local_names(triples: DataFrame) -> DataFrame:
    """(key, iri): local names, in lower case, of one subject only."""
    return _single(triples.filter(is_iri("s")).select(F.lower(local_name("s")).alias("key"), text("s").alias("iri")))


def _single(rows: DataFrame) -> DataFrame:
    g = rows.filter("key <> ''").groupBy("key").agg(F.min("iri").alias("iri"), F.max("iri").alias("last"))
    return g.filter(F.col("iri") == F.col("last")).select("key", "iri")


def canonical(values: DataFrame, column: str, labels: DataFrame, locals_: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``values`` with the column ``canonical``: the first of angle brackets taken off, a web address as it is,
    a known prefix spelt out, the IRI of a unique label or local name, else the trimmed value in lower case."""
    v = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    v = F.when(v.rlike(r"^<.*>$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    fixed = F.when(F.lower(v).rlike("^https?://"), v)
    for p, ns in prefixes.items():
        fixed = F.coalesce(fixed, F.when(F.startswith(v, F.lit(p + ":")), F.concat(F.lit(ns), F.substring(v, F.lit(len(p) + 2), F.length(v)))))
    keyed = values.withColumn("_fixed", fixed).withColumn("_key", match_key(v))
    lab, loc = labels.select(F.col("key").alias("_key"), F.col("iri").alias("_label")), locals_.select(F.col("key").alias("_key"), F.col("iri").alias("_local"))
    out = keyed.join(lab, "_key", "left").join(loc, "_key", "left")
    return out.withColumn("canonical", F.coalesce("_fixed", "_label", "_local", "_key")).drop("_fixed", "_key", "_label", "_local")


def strip_fences(c: Column) -> Column:
    """Text without a Markdown fence around it."""
    t = F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    parts = F.split(t, "```", 3)
    t = F.when(F.startswith(t, F.lit("```")), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.substring(t, F.lit(4), F.length(t)))).otherwise(t)
    return F.regexp_replace(F.regexp_replace(t, r"```$", ""), r"(?U)^\s+|\s+$", "")


def mismatch_budget(columns: int, lenience: float) -> int:
    if not 0 <= lenience <= 1:
        raise ValueError("lenience must lie between 0 and 1")
    return math.floor(columns * lenience)


def _metrics(df: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    df = df.withColumn("precision", F.when(none, 1.0).otherwise(p)).withColumn("recall", F.when(none, 1.0).otherwise(r))
    s = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def score_exact(answers: DataFrame, keys: list[str], cells: str = "cells", side: str = "side", questions: DataFrame | None = None) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 with each row matched at most once and in full.

    ``answers``: keys, side (gold or pred), cells. Greedy matching of equal rows is a multiset intersection.
    Questions listed in ``questions`` but without rows count as right.
    """
    n = answers.groupBy(*keys, cells).agg(F.count_if(F.col(side) == "gold").alias("g"), F.count_if(F.col(side) == "pred").alias("p"))
    s = n.groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("g").alias("gs"), F.sum("p").alias("ps"))
    if questions is not None:
        s = questions.select(*keys).distinct().join(s, keys, "left").fillna(0, ["tp", "gs", "ps"])
    return _metrics(s.select(*keys, "tp", (F.col("ps") - F.col("tp")).alias("fp"), (F.col("gs") - F.col("tp")).alias("fn")))


def greedy(gold: list, pred: list, budget: int) -> int:
    """Pairs found by taking, for each predicted row in order, the first free gold row with at most ``budget``
    cells that differ; a shorter row is compared on its own cells."""
    free = [True] * len(gold)
    hits = 0
    for p in pred:
        for i, g in enumerate(gold):
            if free[i] and sum(a != b for a, b in zip(g, p)) <= budget:
                free[i], hits = False, hits + 1
                break
    return hits


def score_lenient(answers: DataFrame, keys: list[str], budget: int, row_no: str = "row_no", cells: str = "cells", side: str = "side") -> DataFrame:
    """As ``score_exact``, but rows may differ in ``budget`` cells. The order of rows counts; a question's answer
    rows are one group, as the definition of the greedy match asks for."""
    names = [*keys, "tp", "fp", "fn"]
    schema = ", ".join([*(f"{k} {dict(answers.dtypes)[k]}" for k in keys), "tp bigint", "fp bigint", "fn bigint"])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row_no)
        gold, pred = (list(map(list, rows.loc[rows[side] == s, cells])) for s in ("gold", "pred"))
        tp = greedy(gold, pred, budget)
        return pd.DataFrame([(*key, tp, len(pred) - tp, len(gold) - tp)], columns=names)

    return _metrics(answers.groupBy(*keys).applyInPandas(one, schema))


def macro_micro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over questions (NaN for none), and ratios of sums (0 for none)."""
    tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    nan = F.lit(float("nan"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    g = scores.groupBy(*(by or []))
    out = g.agg(*[F.coalesce(F.avg(c), nan).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"))
    s = F.col("micro_precision") + F.col("micro_recall")
    return out.withColumn("micro_f1", F.when(s > 0, 2 * F.col("micro_precision") * F.col("micro_recall") / s).otherwise(0.0))


def mean_std(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation per group; the deviation of one value is 0, those of none are NaN."""
    nan = F.lit(float("nan"))
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), nan).alias("mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.coalesce(F.stddev_samp(value), nan)).alias("std"))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def request_cost(tokens: Column, price: Column, per_request: Column) -> Column:
    """Price times tokens plus a fee, in decimals; unknown prices give null."""
    d = "decimal(38,18)"
    return (price.cast(d) * tokens.cast("decimal(20,0)") + per_request.cast(d)).cast(d)


def cache_key(*cols: Column) -> Column:
    """SHA-256 of the JSON of named columns in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def cached_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Each request with its cached answer: by key, else by path, the one whose columns fit, then the one with as
    many rows as the gold answer, then the smallest key."""
    exact = requests.join(cache.select("key", F.col("columns").alias("c"), F.col("rows").alias("r")), "key", "left")
    hit, miss = exact.filter("c is not null"), exact.filter("c is null").drop("c", "r")
    cand = miss.join(cache.select(F.col("key").alias("k2"), "path", F.col("columns").alias("c"), F.col("rows").alias("r")), "path", "left")
    rank = F.struct((F.col("c") == F.col("columns")).cast("int"), (F.size("r") == F.col("gold_size")).cast("int"))
    best = cand.groupBy("key").agg(F.min_by(F.struct("c", "r"), F.struct((-rank.getField("col1")).alias("a"), (-rank.getField("col2")).alias("b"), F.col("k2"))).alias("b"))
    filled = miss.join(best, "key", "left").select(*miss.columns, F.col("b.c").alias("c"), F.col("b.r").alias("r"))
    return hit.unionByName(filled, allowMissingColumns=True).withColumnRenamed("c", "answer_columns").withColumnRenamed("r", "answer_rows")


def parse_records(replies: DataFrame, reply: str, key: str, fields: str, keep: list[str] | None = None) -> DataFrame:
    """Records of JSON replies {key: [record, ...]}; a reply without such a list gives none."""
    body = F.from_json(strip_fences(F.col(reply)), f"struct<{key}: array<struct<{fields}>>>")
    return replies.select(*(keep or []), F.explode(body[key]).alias("_r")).select(*(keep or []), "_r.*")


def respond(df: DataFrame, prompt: str, responder, result: str = "reply") -> DataFrame:
    """A column of replies by a function from a list of prompts to a list of replies, called per batch on the
    workers. Where no model can be reached the responder reads a cache and returns None for a miss."""
    schema = T.StructType([*df.schema.fields, T.StructField(result, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b[result] = responder(list(b[prompt]))
            yield b

    return df.mapInPandas(run, schema)
