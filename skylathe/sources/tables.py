"""Delimited tables, logs, queries and caches."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

LOG = logging.getLogger(__name__)


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", infer: bool = False, one_line: bool = False) -> DataFrame:
    """A table with a header, quoted line ends kept, empty fields null. A byte-order mark goes.

    Columns are strings; with ``infer`` they get the types their values have. With ``columns`` the header is not
    read. ``one_line``: no value has a line end, so that large files are divided among tasks; else each is one task's.
    """
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", not one_line).option("inferSchema", infer).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = r.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else r.csv(path)
    return df.toDF(*[c.replace("﻿", "").strip('"') for c in df.columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, **kw: bool) -> DataFrame:
    return read_delimited(spark, path, columns, **kw)


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, **kw: bool) -> DataFrame:
    return read_delimited(spark, path, columns, "\t", **kw)


def keep_empty(df: DataFrame) -> DataFrame:
    """Rows as a reader without nulls sees them: missing fields are empty strings."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by an order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, order) of the distinct filled values with the place where each is first seen."""
    v = F.trim(F.col(column))
    return df.select(v.alias(column), order).filter(F.col(column) != "").groupBy(column).agg(F.min(order).alias(order))


def question_of(text: str, fallback: str | None = None) -> str:
    """The first comment line of a query; without one the fallback, else an error."""
    for line in text.splitlines():
        if line.strip().startswith("#"):
            return line.strip().lstrip("#").strip()
    if fallback is None:
        raise ValueError("no comment with the question")
    return fallback


def find_queries(folder: str, recursive: bool = True) -> list[tuple[str, str, str]]:
    """(category, name, text) of the query files below a folder, in order."""
    root = Path(folder)
    if not root.is_dir():
        raise FileNotFoundError(folder)
    paths = sorted(root.rglob("*.rq") if recursive else root.glob("*.rq"))
    return [(str(p.parent.relative_to(root)), p.stem, p.read_text(encoding="utf-8")) for p in paths]


def load_json(path: str, strict: bool = False) -> dict:
    """A JSON cache: missing gives an empty one; broken gives an empty one with a warning, or an error if strict."""
    p = Path(path)
    if not p.exists():
        if strict:
            raise FileNotFoundError(path)
        return {}
    try:
        return json.loads(p.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        if strict:
            raise ValueError(f"{path} is no JSON") from e
        LOG.warning("%s is no JSON and is not used", path)
        return {}


def read_catalog(spark: SparkSession, path: str, media_types: tuple[str, ...] = ("text/turtle", "application/trig", "application/n-triples", "application/n-quads", "application/ld+json", "application/rdf+xml")) -> DataFrame:
    """(url, media_type): the distinct downloads of a data catalog that hold graph data."""
    df = spark.read.option("multiLine", True).json(path)
    d = df.select(F.explode("dataset").alias("d")).select(F.explode("d.distribution").alias("f"))
    url, kind = F.col("f.contentUrl").alias("url"), F.col("f.encodingFormat").alias("media_type")
    return d.select(url, kind).filter(F.col("media_type").isin(*media_types) & F.col("url").isNotNull()).distinct()


def price_table(spark: SparkSession, rows: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(model, prompt_price, request_price) from a list; nothing is fetched."""
    return spark.createDataFrame(rows, "model string, prompt_price double, request_price double")


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """``df`` with row_no from 1 per the order.

    Row numbers come from counts per range partition, so the order is total without one task seeing all rows.
    """
    part = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_pid", F.spark_partition_id()))
    counts = part.groupBy("_pid").count()  # one row a partition
    before = counts.select("_pid", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(order))
    return part.withColumn("_n", own).join(F.broadcast(before), "_pid").select(*df.columns, (F.col("_n") + F.col("_off")).alias("row_no"))
