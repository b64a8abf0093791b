"""Part mentions linked to catalog entries: blocking on the head noun, TF-IDF cosine, cut at the first drop.

TF-IDF is relational: tokens, document frequencies and weights are tables, the dot product a join on terms
within the block (head noun = type). tf is the raw count, idf ln((1 + n) / (1 + df)) + 1, vectors have
length 1. Tokens have two or more word characters; stop words are a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import underscore_slug

# What else a word of a mention may mean, by the word.
SYNONYMS = {"cyl": ["cylinder"], "baffle": ["baffling"], "intake": ["induction"], "line": ["pipe", "tube"]}
TEXT_COLUMNS = ("section", "figure", "type", "specifics")
DROP = 0.5


def lemma(c: Column) -> Column:
    """A noun in the singular by its ending: ies to y, es (not ses) off, s (not ss) off."""
    t = F.lower(c)
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    return (
        F.when(F.endswith(t, F.lit("ies")), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(t, F.lit("es")) & ~F.endswith(t, F.lit("ses")), cut(2))
        .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), cut(1))
        .otherwise(t)
    )


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda w: w != "")


def split_head(c: Column) -> tuple[Column, Column]:
    """Lemma of the last word, and the words before it."""
    w = _words(c)
    return lemma(F.try_element_at(w, F.lit(-1))), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ")


def mentions(df: DataFrame, part: str = "part") -> DataFrame:
    """(mention): distinct filled values, trimmed."""
    m = F.trim(F.regexp_replace(F.col(part), r"(?U)^\s+|\s+$", ""))
    return df.select(m.alias("mention")).filter("mention <> ''").distinct()


def expand(tokens: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Sorted distinct tokens with what they may also mean."""
    out = tokens
    for k, v in (SYNONYMS if synonyms is None else synonyms).items():
        out = F.when(F.array_contains(tokens, k), F.array_union(out, F.array(*map(F.lit, v)))).otherwise(out)
    return F.array_sort(F.array_distinct(out))


def normalise_catalog(df: DataFrame, section: str, figure: str, number: str, kind: str, specifics: str, order: str) -> DataFrame:
    """order, section, figure, part_number, type (lower case), specifics, label, head."""
    t, s = F.lower(F.coalesce(F.col(kind).cast("string"), F.lit("nan"))), F.coalesce(F.col(specifics), F.lit(""))
    return df.select(
        F.col(order).alias("order"), F.coalesce(section, F.lit("")).alias("section"), F.coalesce(figure, F.lit("")).alias("figure"),
        F.col(number).cast("string").alias("part_number"), t.alias("type"), s.alias("specifics"),
        F.trim(F.concat(F.trim(s), F.lit(" "), F.upper(t))).alias("label"), lemma(t).alias("head"),
    )


def _terms(c: Column, stop: list[str]) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w\w+)\b"), 1)
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def idf(catalog: DataFrame, stop: list[str]) -> DataFrame:
    """(term, idf) over the descriptions of the whole catalog."""
    docs = catalog.select(F.array_distinct(_terms(F.concat_ws(" ", *TEXT_COLUMNS), stop)).alias("t"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row


def weights(rows: DataFrame, key: list[str], text: Column, idfs: DataFrame, stop: list[str]) -> DataFrame:
    """(key, term, w): vectors of length 1; terms the catalog does not have are left out."""
    tf = rows.select(*key, F.explode(_terms(text, stop)).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idfs, "term").select(*key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def score(ment: DataFrame, catalog: DataFrame, synonyms: dict[str, list[str]] | None = None, stop: list[str] | None = None) -> DataFrame:
    """(mention, order, part_number, score) of the catalog rows whose type is the mention's head noun."""
    stop = stop or []
    head, _ = split_head(F.lower("mention"))
    m = ment.select("mention", head.alias("head"), F.array_join(expand(_words(F.lower("mention")), synonyms), " ").alias("query"))
    idfs = idf(catalog, stop)
    q = weights(m, ["mention", "head"], F.col("query"), idfs, stop)
    c = weights(catalog, ["order", "part_number", "head"], F.concat_ws(" ", *TEXT_COLUMNS), idfs, stop)
    dot = q.withColumnRenamed("w", "wq").join(c, ["head", "term"]).groupBy("mention", "order", "part_number").agg(F.sum(F.col("wq") * F.col("w")).alias("score"))
    return dot.filter("score > 0")


def cut_at_drop(scored: DataFrame, drop: float = DROP) -> DataFrame:
    """(mention, part_number, confidence): best entries up to the first drop by more than a share of the score.

    Scores become shares of what is kept. A part number with several rows counts in the sum with each, and
    keeps its lowest share. Ties go by catalog order. A block of one head noun bounds the window.
    """
    w = Window.partitionBy("mention").orderBy(F.desc(F.round("score", 12)), "order")
    nxt = F.lead("score").over(w)
    steps = scored.withColumn("drop", F.coalesce((F.col("score") - nxt) / F.col("score"), F.lit(0.0)) > drop)
    before = F.coalesce(F.sum(F.col("drop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = steps.withColumn("b", before).filter("b = 0")
    share = F.col("score") / F.sum("score").over(Window.partitionBy("mention"))
    return kept.withColumn("share", share).groupBy("mention", "part_number").agg(F.min("share").alias("share")).select("mention", "part_number", F.round("share", 5).alias("confidence"))


def link(ment: DataFrame, catalog: DataFrame, drop: float = DROP, synonyms: dict[str, list[str]] | None = None, stop: list[str] | None = None) -> DataFrame:
    return cut_at_drop(score(ment, catalog, synonyms, stop), drop)


def simplify(links: DataFrame) -> DataFrame:
    """The best entry of each mention; ties by part number."""
    return links.groupBy("mention").agg(F.max_by(F.struct("part_number", "confidence"), F.struct("confidence", F.reverse("part_number"))).alias("t")).select("mention", "t.*")


def mapping_rows(links: DataFrame, catalog: DataFrame, tool: str, source: str, checksum: str, date: str, prefix: str = "kg", predicate: str = "skos:relatedMatch", justification: str = "semapv:LexicalSimilarityThresholdMatching") -> DataFrame:
    """Rows of a mapping set: ids, labels, confidence and where they come from. ``date`` is given, so runs agree."""
    first = catalog.groupBy("part_number").agg(F.min_by("label", "order").alias("object_label"))
    _, modifiers = split_head(F.lower("mention"))
    slug = underscore_slug(F.col("mention"))
    lit = F.lit
    return links.join(first, "part_number").select(
        F.concat(lit(f"{prefix}:mapping/"), slug, lit("--"), underscore_slug(F.col("part_number"))).alias("mapping_id"),
        F.concat(lit(f"{prefix}:part-mention/"), slug).alias("subject_id"), F.col("mention").alias("subject_label"),
        F.concat(lit(f"{prefix}:partnr-"), F.col("part_number")).alias("object_id"), "object_label",
        lit(predicate).alias("predicate_id"), lit(date).alias("mapping_date"), lit(justification).alias("mapping_justification"),
        "confidence", lit(tool).alias("mapping_tool"), lit(source).alias("mapping_source"), lit(checksum).alias("mapping_source_checksum"),
        lit("part").alias("mapping_source_column"), modifiers.alias("mapping_notes"),
    )
