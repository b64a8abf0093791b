"""Turtle, TriG and N-Triples/N-Quads files as quads (g, s, p, o) of N-Triples terms.

A file is parsed by one task (the syntax has no place to cut it); many files are parsed in parallel. Blank
nodes are scoped to their file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, XSD, escape_py
from ..plans.sparql import unquote

_TOKEN = re.compile(
    r"""(?P<skip>[\s﻿]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<bnode>_:\w(?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|[+-]?\d*\.\d+|[+-]?\d+)
    |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z]+)|(?P<punct>\^\^|[{}()\[\].;,])""",
    re.X,
)


class RdfError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, scope: str, graph: str) -> None:
        self.text, self.at = text, 0
        self.scope, self.default = scope, graph
        self.prefixes: dict[str, str] = {}
        self.base, self.fresh = "", 0
        self.out: list[tuple[str, str, str, str]] = []
        self.graph = graph
        self.kind, self.value = "", ""
        self.next()

    def next(self) -> tuple[str, str]:
        old = (self.kind, self.value)
        while True:
            if self.at >= len(self.text):
                self.kind, self.value = "end", ""
                return old
            m = _TOKEN.match(self.text, self.at)
            if not m:
                raise RdfError(f"cannot read {self.text[self.at:self.at + 40]!r}")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup or "", m.group()
                return old

    def accept(self, v: str) -> bool:
        if self.value == v and self.kind in ("punct", "word"):
            self.next()
            return True
        return False

    def expect(self, v: str) -> None:
        if not self.accept(v):
            raise RdfError(f"expected {v}, found {self.value!r}")

    def parse(self) -> list[tuple[str, str, str, str]]:
        while self.kind != "end":
            word = self.value.lower()
            if (self.kind == "at" and word in ("@prefix", "@base")) or (self.kind == "word" and word in ("prefix", "base")):
                dotted = self.kind == "at"
                self.next()
                if word.endswith("prefix"):
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.iri(self.next())[1:-1]
                else:
                    self.base = self.next()[1][1:-1]
                if dotted:
                    self.expect(".")
                continue
            if self.kind == "word" and word == "graph":
                self.next()
                self.block(self.term())
                continue
            if self.kind == "punct" and self.value == "{":
                self.block(self.default)
                continue
            s = self.subject()
            if self.value == "{":
                self.block(s)
            else:
                self.statement(s)
                if self.value != ".":  # N-Quads: a graph label at the end
                    raise RdfError(f"expected ., found {self.value!r}")
                self.next()
        return self.out

    def block(self, graph: str) -> None:
        self.graph = graph
        self.expect("{")
        while not self.accept("}"):
            if self.accept("."):
                continue
            self.statement(self.subject())
        self.graph = self.default

    def statement(self, s: str) -> None:
        if self.value in (".", "}") and s.startswith("_:"):
            return  # [ ... ] alone
        self.properties(s)

    def properties(self, s: str) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.next()
                p = f"<{RDF}type>"
            else:
                p = self.iri(self.next())
            while True:
                start = len(self.out)
                o = self.object()
                if self.kind in ("iri", "bnode") and self.graph == self.default and self.peeks_end():
                    self.out.append((self.term(), s, p, o))
                else:
                    self.out.insert(start, (self.graph, s, p, o)) if len(self.out) > start else self.out.append((self.graph, s, p, o))
                if not self.accept(","):
                    break
            more = False
            while self.accept(";"):
                more = True
            if not more or self.value in (".", "]", "}") or self.kind == "end":
                return

    def peeks_end(self) -> bool:
        m = re.compile(r"\s*\.").match(self.text, self.at)
        return bool(m)

    def subject(self) -> str:
        if self.accept("["):
            return self.anonymous()
        if self.accept("("):
            return self.collection()
        return self.term()

    def object(self) -> str:
        return self.subject()

    def new(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}n{self.fresh}"

    def anonymous(self) -> str:
        b = self.new()
        if not self.accept("]"):
            self.properties(b)
            self.expect("]")
        return b

    def collection(self) -> str:
        items = []
        while not self.accept(")"):
            items.append(self.subject())
        head = f"<{RDF}nil>"
        for item in reversed(items):
            b = self.new()
            self.out += [(self.graph, b, f"<{RDF}first>", item), (self.graph, b, f"<{RDF}rest>", head)]
            head = b
        return head

    def iri(self, token: tuple[str, str]) -> str:
        kind, v = token
        if kind == "iri":
            body = v[1:-1]
            return v if re.match(r"[A-Za-z][\w+.-]*:", body) else f"<{self.base}{body}>"
        if kind == "pname":
            prefix, _, name = v.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', name)}>"
        raise RdfError(f"expected an IRI, found {v!r}")

    def term(self) -> str:
        kind, v = self.next()
        if kind == "string":
            body = f'"{escape_py(unquote(v))}"'
            if self.kind == "at":
                return body + self.next()[1]
            if self.accept("^^"):
                t = self.iri(self.next())
                return body if t == f"<{XSD}string>" else f"{body}^^{t}"
            return body
        if kind == "number":
            return f'"{v}"^^<{XSD}{"double" if "e" in v.lower() else "decimal" if "." in v else "integer"}>'
        if kind == "word" and v in ("true", "false"):
            return f'"{v}"^^<{XSD}boolean>'
        if kind == "bnode":
            return f"_:{self.scope}b{v[2:]}"
        return self.iri((kind, v))


def parse_rdf(text: str, name: str = "", graph: str | None = None) -> list[tuple[str, str, str, str]]:
    """Quads of one document; ``name`` scopes its blank nodes, ``graph`` names its default graph."""
    scope = f"f{xxhash.xxh3_64_hexdigest(name)}" if name else ""
    return _Parser(text, scope, graph or f"<file:{name}>").parse()


def read_files(spark: SparkSession, paths: list[str], on_error: str = "raise") -> DataFrame:
    """Quads of RDF files. ``on_error``: raise, or skip a file that cannot be read as a whole."""
    if not paths:
        return spark.createDataFrame([], "g string, s string, p string, o string")
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["value"]):
                try:
                    quads = parse_rdf(text, path.rsplit("/", 1)[-1])
                except RdfError as e:
                    if on_error == "raise":
                        raise RdfError(f"{path}: {e}") from e
                    quads = []
                yield pd.DataFrame(quads, columns=["g", "s", "p", "o"])

    return files.mapInPandas(run, "g string, s string, p string, o string")


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples, line by line, so that large files are divided among tasks. Terms are taken as they
    are written; blank and comment lines are left out, any other line that is no triple is an error."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    hit = F.regexp_extract("value", _LINE, 1) != ""
    checked = F.when(hit, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no triple: "), F.col("value"))))
    return lines.select(checked.alias("value")).select(*[F.regexp_extract("value", _LINE, i + 1).alias(c) for i, c in enumerate("spo")])


def read_directory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".ttl", ".trig", ".nt"), exclude_prefix: str | None = None, on_error: str = "skip") -> DataFrame:
    """Quads of the files of a folder in order of their names; a missing folder is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(folder)
    names = sorted(f.getPath().getName() for f in fs.listStatus(where))
    names = [n for n in names if n.endswith(suffixes) and not (exclude_prefix and n.startswith(exclude_prefix))]
    return read_files(spark, [f"{folder.rstrip('/')}/{n}" for n in names], on_error)
