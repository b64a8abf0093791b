"""Query runs with their status and time, reports on them, and charts of a result's largest rows."""

from __future__ import annotations

import re
import textwrap
import time
from collections import Counter
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planner import run


@dataclass
class Outcome:
    category: str
    name: str
    question: str
    status: str  #: pass, empty or error
    rows: int
    seconds: float
    note: str = ""


def shorten(text: str, width: int = 120) -> str:
    one = " ".join(text.split())
    return one if len(one) <= width else one[: width - 1] + "…"


def execute(store, category: str, name: str, question: str, query: str) -> Outcome:
    """Runs a query and counts its solutions; errors are outcomes."""
    start = time.time()
    try:
        result = run(store, query)
        n = int(result) if isinstance(result, bool) else result.count()
        return Outcome(category, name, question, "pass" if n else "empty", n, time.time() - start)
    except Exception as e:  # a report lists what failed
        return Outcome(category, name, question, "error", 0, time.time() - start, shorten(str(e)))


def status_counts(outcomes: list[Outcome]) -> dict[str, int]:
    c = Counter(o.status for o in outcomes)
    return {s: c.get(s, 0) for s in ("pass", "empty", "error")}


def markdown(outcomes: list[Outcome], title: str = "Query report") -> str:
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in status_counts(outcomes).items()), ""]
    for cat in sorted({o.category for o in outcomes}):
        lines += [f"## {cat}", "", "| query | status | rows | seconds | question | note |", "| --- | --- | ---: | ---: | --- | --- |"]
        lines += [f"| {o.name} | {o.status} | {o.rows} | {o.seconds:.3f} | {o.question} | {o.note} |" for o in outcomes if o.category == cat]
        lines.append("")
    return "\n".join(lines)


def as_json(outcomes: list[Outcome]) -> dict:
    return {f"{o.category}/{o.name}": asdict(o) for o in outcomes}


# ---- charts ----------------------------------------------------------------------------------------------

# What a column of numbers to be shown is called.
NUMBER_NAMES = ("count", "freq", "frequency", "total", "num", "value", "score", "sum")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns all of whose filled values are numbers, and that have some."""
    tests = [F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull())), F.lit(False)).alias(c) for c in df.columns]
    r = df.agg(*tests).first()
    return [c for c in df.columns if r[c]]


def value_column(df: DataFrame, wanted: str | None = None) -> str:
    numeric = numeric_columns(df)
    if wanted:
        if wanted not in numeric:
            raise ValueError(f"{wanted} is no column of numbers")
        return wanted
    if not numeric:
        raise ValueError("no column of numbers")
    return next((c for c in numeric if any(n in c.lower() for n in NUMBER_NAMES)), numeric[0])


def label_columns(df: DataFrame, value: str) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c != value and c not in numeric] or [c for c in df.columns if c != value] or [value]


def prettify(label: str) -> str:
    s = re.split(r"[#/]", label)[-1] or label
    s = re.sub(r"[_-]+", " ", s)
    return re.sub(r"([a-z])([A-Z])", r"\1 \2", s).strip()


def chart_rows(df: DataFrame, top: int = 20, least: float | None = None, value: str | None = None, labels: list[str] | None = None) -> list[tuple[str, float]]:
    """(label, number) in falling order: sorted, those below ``least`` left out, the first ``top`` (0: all)."""
    v = value_column(df, value)
    ls = labels or label_columns(df, v)
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(ls)], F.col(v).cast("string").try_cast("double").alias("v")).filter("v is not null")
    rows = rows.orderBy(F.desc("v"), *[f"l{i}" for i in range(len(ls))])
    if least is not None:
        rows = rows.filter(F.col("v") >= least)
    if top:
        rows = rows.limit(top)
    return [(" • ".join(prettify(r[f"l{i}"]) for i in range(len(ls))), r["v"]) for r in rows.toLocalIterator()]


def draw(rows: list[tuple[str, float]], path: str, title: str = "", width: int = 40) -> None:
    """A bar chart as a PNG, where matplotlib is installed."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    names = ["\n".join(textwrap.wrap(n, width)) for n, _ in rows]
    fig, ax = plt.subplots(figsize=(10, max(2, 0.4 * len(rows))))
    ax.barh(names[::-1], [v for _, v in rows][::-1])
    ax.set_title(title)
    fig.tight_layout()
    fig.savefig(path)
    plt.close(fig)
