"""Requests to a language model about components and functions, and the tables in its replies.

The model itself is a responder given by the caller (``scoring.respond``); lists are distinct and in first-seen order.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import first_seen


def cause_stem(c: Column) -> Column:
    """A cause up to its first parenthesis."""
    return F.regexp_extract(c, r"^(.*?)(?:$| \()", 1)


def bullets(df: DataFrame, column: str, order: str, block: int = 10_000) -> Iterator[str]:
    """The distinct values of a column as lists for prompts of ``block`` values each, in first-seen order."""
    held: list[str] = []
    for r in first_seen(df, column, order).orderBy(order).toLocalIterator():
        held.append(f"- {r[column]}")
        if len(held) == block:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def component_prompt(description: str, systems: str, assemblies: str) -> str:
    return f"{description}\n\nSystems:\n{systems}\n\nAssemblies:\n{assemblies}\n\nGive a tab-separated table with the header Component, hasFunction: each name above, exactly, and its function as a short phrase with a verb in -ing."


def dependency_prompt() -> str:
    return "Give a tab-separated table with the header Function, dependsOn, parentFunction for the functions of the table before: the functions each depends on, separated by semicolons, and its more general function; cells may be empty, names stay exact."


def failure_prompt(troubles: str, causes: str) -> str:
    return f"Give a tab-separated table with the header Problem, ofComponent, failingFunction: for each problem the component it concerns and the function of it that fails, by their exact names.\n\n{troubles}\n{causes}"


def unfence(text: str) -> str:
    """Text without a Markdown fence and its language."""
    t = text.strip()
    if t.startswith("```"):
        head, _, rest = t[3:].partition("\n")
        t = rest if head.strip().isalpha() or not head.strip() else t[3:]
    return t.removesuffix("```").strip()


def save_tsv(reply: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(unfence(reply) + "\n", encoding="utf-8")
