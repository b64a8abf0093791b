"""Entities in log lines: span labels from annotations, and two taggers trained on them: a dictionary of phrases, and
an averaged perceptron over the words of a line and their neighbours."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .extraction import label_values

LABELS = ("location", "part", "tggedproblem")
#: Annotated rows that the perceptron is trained on, at most; the first by a hash of their texts.
TRAIN_ROWS = 5_000
TOKEN = re.compile(r"\w+|[^\w\s]")


def find_span(text: str, value: str, used: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The first place of a value, without case, that overlaps no span in use."""
    low, want, at = text.lower(), value.lower(), 0
    if not want:
        return None
    while (i := low.find(want, at)) >= 0:
        j = i + len(want)
        if all(j <= a or i >= b for a, b in used):
            return i, j
        at = i + 1
    return None


def annotate(df: DataFrame, ident: str = "ident", text: str = "problem", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(ident, text, spans) with spans (start, end, label) of the annotated values, labels in the given order."""
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"), *[label_values(F.col(c)).alias(c) for c in labels]).filter(F.trim("text") != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, *values in b.itertuples(index=False):
                used: list[tuple[int, int]] = []
                spans = []
                for name, vs in zip(labels, values):
                    for v in vs if vs is not None else ():
                        s = find_span(t, v, used)
                        if s:
                            used.append(s)
                            spans.append({"start": s[0], "end": s[1], "label": name})
                out.append((i, t, spans))
            yield pd.DataFrame(out, columns=["ident", "text", "spans"])

    return rows.mapInPandas(run, "ident string, text string, spans array<struct<start: int, end: int, label: string>>")


def train_test(df: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([1 - share, share], seed)
    return train, test


def train_tagger(annotated: DataFrame, least: int = 2) -> DataFrame:
    """(phrase, label, n): annotated phrases with their most frequent label, if seen ``least`` times."""
    s = annotated.select("text", F.explode("spans").alias("s")).select(F.lower(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("phrase"), "s.label")
    n = s.groupBy("phrase", "label").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("phrase").agg(F.max_by(F.struct("label", "n"), F.struct("n", "label")).alias("b"), F.sum("n").alias("all"))
    return best.filter(F.col("all") >= least).select("phrase", "b.label", "b.n")


def tag(df: DataFrame, model: DataFrame, ident: str = "ident", text: str = "problem") -> DataFrame:
    """(id, text, location, part, tggedproblem): phrases of the model in each text, longest first from the left,
    distinct, sorted, joined by "; ". Blank texts are left out.

    Each distinct text gives the runs of its words of the lengths that phrases have; runs and phrases meet in an
    equi-join, so the model may be of any size. ``model``: phrase, unique, in lower case, and label.
    """
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).filter(F.trim("text") != "")
    model = cut(model.select("phrase", "label").withColumn("w", F.size(F.regexp_extract_all("phrase", F.lit(r"\w+|[^\w\s]"), 0))))
    lengths = sorted(r["w"] for r in model.select("w").distinct().collect())  # words of a phrase: few values

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                low = t.lower()
                if len(low) != len(t):  # letters that change their length are compared as they are
                    low = t
                at = [m.span() for m in re.finditer(r"\w+|[^\w\s]", low)]
                for n in lengths:
                    for i in range(len(at) - n + 1):
                        out.append((t, low[at[i][0] : at[i + n - 1][1]], at[i][0], at[i + n - 1][1]))
            yield pd.DataFrame(out, columns=["text", "phrase", "a", "z"])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans in zip(b["text"], b["spans"]):
                found: dict[str, set] = {n: set() for n in LABELS}
                end = 0
                for s in sorted(spans, key=lambda s: (s["a"], -s["z"])):
                    if s["a"] >= end:
                        found[s["label"]].add(t[s["a"] : s["z"]])
                        end = s["z"]
                out.append((t, *["; ".join(sorted(found[n])) for n in LABELS]))
            yield pd.DataFrame(out, columns=["text", *LABELS])

    distinct = rows.select("text").distinct()
    hits = distinct.mapInPandas(runs, "text string, phrase string, a int, z int").join(model.select("phrase", "label"), "phrase")
    spans = hits.groupBy("text").agg(F.collect_list(F.struct("a", "z", "label")).alias("spans"))  # as many as a text has words
    tagged = spans.mapInPandas(pick, "text string, location string, part string, tggedproblem string")
    return rows.join(tagged, "text", "left").select("id", "text", *[F.coalesce(n, F.lit("")).alias(n) for n in LABELS])


def save_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


# ---- averaged perceptron -----------------------------------------------------------------------------------

TAGS = ("O", *(f"{b}-{n}" for n in LABELS for b in "BI"))


def _features(words: list[str], i: int, before: str) -> list[str]:
    """What the tag of a word may depend on: itself, its ends and shape, its neighbours, the tag before."""
    w = words[i]
    prev, after = words[i - 1] if i else "<", words[i + 1] if i + 1 < len(words) else ">"
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", w))[:4]
    return ["bias", f"w={w}", f"p={w[:3]}", f"s={w[-3:]}", f"h={shape}", f"-1={prev}", f"+1={after}", f"t={before}", f"t={before} w={w}", f"-1={prev} w={w}"]


def _decode(words: list[str], weights: dict[str, dict[str, float]]) -> list[str]:
    tags: list[str] = []
    for i in range(len(words)):
        before = tags[-1] if tags else "<"
        score = dict.fromkeys(TAGS, 0.0)
        for f in _features(words, i, before):
            for t, w in weights.get(f, {}).items():
                score[t] += w
        fits = [t for t in TAGS if t[0] != "I" or before[1:] == t[1:]]  # a phrase goes on only as what it began
        tags.append(max(fits, key=lambda t: score[t]))
    return tags


def _gold(text: str, spans: list) -> tuple[list[str], list[str]]:
    at = [m.span() for m in TOKEN.finditer(text)]
    tags = []
    for a, z in at:
        own = next((s for s in spans if s["start"] <= a and z <= s["end"]), None)
        tags.append("O" if own is None else f"{'B' if a == own['start'] else 'I'}-{own['label']}")
    fit = [t if t[0] != "I" or (i and tags[i - 1][1:] == t[1:]) else f"B{t[1:]}" for i, t in enumerate(tags)]
    return [text[a:z].lower() for a, z in at], fit


def train_perceptron(annotated: DataFrame, rows: int = TRAIN_ROWS, epochs: int = 5, seed: int = 7) -> DataFrame:
    """(feature, tag, weight) of a tagger trained on at most ``rows`` annotated rows (text, spans), chosen by a hash
    of the text, so that the choice does not depend on how the rows are stored. Training runs on the driver on this bounded
    sample; tagging is distributed."""
    sample = annotated.select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    data = [_gold(r["text"], r["spans"]) for r in sample]
    now: dict[str, dict[str, float]] = {}
    total: dict[tuple[str, str], float] = {}
    since: dict[tuple[str, str], int] = {}
    step = 0

    def change(f: str, t: str, by: float) -> None:
        held = now.setdefault(f, {})
        total[f, t] = total.get((f, t), 0.0) + (step - since.get((f, t), 0)) * held.get(t, 0.0)
        since[f, t] = step
        held[t] = held.get(t, 0.0) + by

    rnd = random.Random(seed)
    for _ in range(epochs):
        rnd.shuffle(data)
        for words, gold in data:
            step += 1
            found = _decode(words, now)
            if found == gold:
                continue
            for i, (a, b) in enumerate(zip(found, gold)):
                was, right = (found[i - 1], gold[i - 1]) if i else ("<", "<")
                if a != b or was != right:
                    for f in _features(words, i, right):
                        change(f, b, 1.0)
                    for f in _features(words, i, was):
                        change(f, a, -1.0)
    out = []
    for f, held in now.items():
        for t, w in held.items():
            mean = (total.get((f, t), 0.0) + (step - since.get((f, t), 0)) * w) / max(1, step)
            if mean:
                out.append((f, t, mean))
    return annotated.sparkSession.createDataFrame(out, "feature string, tag string, weight double")


def tag_perceptron(df: DataFrame, model: DataFrame, ident: str = "ident", text: str = "problem") -> DataFrame:
    """As ``tag``, by a model of ``train_perceptron``, whose size its bounded sample bounds. Each distinct text is tagged once."""
    weights: dict[str, dict[str, float]] = {}
    for r in model.collect():
        weights.setdefault(r["feature"], {})[r["tag"]] = r["weight"]
    shipped = df.sparkSession.sparkContext.broadcast(weights)
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).filter(F.trim("text") != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                at = [m.span() for m in TOKEN.finditer(t)]
                found: dict[str, set] = {n: set() for n in LABELS}
                spans: list[list] = []
                for (a, z), tag_ in zip(at, _decode([t[a:z].lower() for a, z in at], shipped.value)):
                    if tag_[0] == "B":
                        spans.append([a, z, tag_[2:]])
                    elif tag_[0] == "I":
                        spans[-1][1] = z
                for a, z, n in spans:
                    found[n].add(t[a:z])
                out.append((t, *["; ".join(sorted(found[n])) for n in LABELS]))
            yield pd.DataFrame(out, columns=["text", *LABELS])

    tagged = rows.select("text").distinct().mapInPandas(run, "text string, location string, part string, tggedproblem string")
    return rows.join(tagged, "text").select("id", "text", *LABELS)
