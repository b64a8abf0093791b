"""Algebra to DataFrames. Catalyst does the rest.

Constants become filters on one predicate's triples; patterns are joined in an order that starts with bound
ones and stays connected; a pattern that binds nothing new is a semi-join; what is shared and always bound is an
equi-join. Only variables that may be unbound need a join on compatibility.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators.closure import closure
from ..session import cut, cut_count
from .algebra import Bgp, Extend, Filter, Graph, Join, LeftJoin, Minus, Path, Pattern, Query, Union, Values, Var
from .sparql import SparqlError, parse


#: Most pairs of solutions that parts of a pattern without a common variable may make.
PRODUCT_ROWS = 10_000_000
#: Most rows of the beginning of a path that are broadcast.
BROADCAST_ROWS = 200_000


@dataclass
class Rel:
    df: DataFrame
    sure: dict[str, bool]  #: variable -> always bound
    raw: DataFrame | None = None  #: the same solutions, possibly repeated, where that is cheaper

    @property
    def names(self) -> list[str]:
        return list(self.sure)


@dataclass
class Typed:
    kind: str  #: term (encoded), str, num, bool
    col: Column


class Planner:
    def __init__(self, store) -> None:
        self.store, self.spark = store, store.spark
        self.scope: DataFrame | None = None  # triples of one graph, inside GRAPH

    # ---- patterns ----------------------------------------------------------------------------------

    def edges(self, p: str) -> DataFrame:
        if self.scope is not None:
            return self.scope.filter(F.col("p") == p).select("s", "o")
        return self.store.predicate(p)

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(), {})

    def pattern(self, pat: Pattern, bound: Rel | None) -> Rel:
        if isinstance(pat.p, Path):
            s, o = self.seed(pat.s, bound, "s"), self.seed(pat.o, bound, "o")
            if isinstance(pat.s, Var) and not isinstance(pat.o, Var):
                s = None  # a constant end is the better start
            df = self.path(pat.p, s, o)
            cols = (("s", pat.s), ("o", pat.o))
        elif isinstance(pat.p, Var):
            df = self.scope if self.scope is not None else self.store.triples()
            cols = (("s", pat.s), ("p", pat.p), ("o", pat.o))
        else:
            df = self.edges(pat.p)
            cols = (("s", pat.s), ("o", pat.o))
        seen: dict[str, str] = {}
        tests = []
        for c, t in cols:
            if not isinstance(t, Var):
                tests.append(F.col(c) == t)
            elif t.name in seen:
                tests.append(F.col(c) == F.col(seen[t.name]))
            else:
                seen[t.name] = c

        def kept(rows: DataFrame) -> DataFrame:
            return reduce(DataFrame.filter, tests, rows).select(*[F.col(c).alias(n) for n, c in seen.items()])

        repeated = self.store.rows(pat.p) if isinstance(pat.p, str) and self.scope is None else None
        return Rel(kept(df), dict.fromkeys(seen, True), kept(repeated) if repeated is not None else None)

    def seed(self, t: Var | str, bound: Rel | None, column: str) -> DataFrame | None:
        """The values an end of a path can have, if known."""
        if not isinstance(t, Var):
            return self.spark.createDataFrame([(t,)], f"{column} string")
        if bound is not None and bound.sure.get(t.name):
            return bound.df.select(F.col(t.name).alias(column)).distinct()
        return None

    def path(self, path: Path, s: DataFrame | None, o: DataFrame | None) -> DataFrame:
        """(s, o) pairs of a path; for +, * and ? as a set, starting from the bound end."""
        op, args = path.op, path.args
        if op == "iri":
            return self.edges(args[0])
        if op == "inv":
            back = self.path(args[0], o.select(F.col("o").alias("s")) if o is not None else None, s.select(F.col("s").alias("o")) if s is not None else None)
            return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "seq":
            return self.sequence(args, s, o)
        if op == "alt":
            return reduce(DataFrame.unionByName, [self.path(a, s, o) for a in args])
        step = self.path(args[0], None, None)
        if op == "opt":
            pairs = step
        elif s is not None:
            pairs = closure(step, s)
        elif o is not None:
            pairs = closure(step, o, backward=True)
        else:
            pairs = closure(step)
        if op == "plus":
            return pairs
        if s is not None:
            same = s.select("s", F.col("s").alias("o"))
        elif o is not None:
            same = o.select(F.col("o").alias("s"), "o")
        else:
            t = self.scope if self.scope is not None else self.store.triples()
            same = t.select("s").union(t.select("o")).distinct().select("s", F.col("s").alias("o"))
        return pairs.unionByName(same).distinct()

    def sequence(self, steps: tuple, s: DataFrame | None, o: DataFrame | None) -> DataFrame:
        """(s, o) pairs of steps one behind the other, as often as there are ways. From a bound end each step starts at
        the nodes reached before it; only without one the steps are joined as a whole."""
        if s is None and o is not None:
            back = self.sequence(tuple(Path("inv", (x,)) for x in reversed(steps)), o.select(F.col("o").alias("s")), None)
            return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
        out = None
        for k, step in enumerate(steps):
            ends, few = None, False
            if s is not None:
                have, n = cut_count(s if out is None else out)
                few = n <= BROADCAST_ROWS
                ends = have.select(F.col("s" if out is None else "o").alias("s")).distinct()
                ends = F.broadcast(ends) if few else ends
                out = None if out is None else have
            nxt = self.path(step, ends, o if k == len(steps) - 1 else None)
            if ends is not None:
                nxt = nxt.join(ends, "s", "left_semi")
            if out is not None:
                first, then = out.select("s", F.col("o").alias("m")), nxt.select(F.col("s").alias("m"), F.col("o").alias("e"))
                nxt = (F.broadcast(first) if few else first).join(then, "m").select("s", F.col("e").alias("o"))
            out = nxt
        return out

    def bgp(self, node: Bgp, given: Rel | None = None) -> Rel:
        """Patterns joined in an order that stays connected. Groups of patterns without a common variable are put
        together at the end."""
        left = list(node.patterns)
        groups: list[Rel] = []
        out = given
        while left:
            have = set(out.names) if out is not None else set()

            def ends(p: Pattern) -> list:
                return [p.s, p.o] if isinstance(p.p, Path) else [p.s, p.p, p.o]

            def linked(p: Pattern) -> int:
                return sum(isinstance(t, Var) and t.name in have for t in ends(p))

            def rank(p: Pattern) -> tuple:
                fixed = sum(not isinstance(t, Var) for t in (p.s, p.o))
                return (out is None or bool(linked(p)), fixed + linked(p), not isinstance(p.p, (Path, Var)), fixed)

            best = max(left, key=rank)
            if out is not None and not linked(best) and any(isinstance(t, Var) for t in ends(best)):
                groups.append(out)
                out = None
                continue
            left.remove(best)
            rel = self.pattern(best, out)
            out = rel if out is None else self.join(out, rel, unique=not isinstance(best.p, Path))
        if out is None:
            out = self.unit()
        for g in reversed(groups):
            out = self.join(g, out)
        return out

    # ---- joins -------------------------------------------------------------------------------------

    def product(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """All pairs of rows, where a query asks for them because nothing links its parts; refused above
        ``PRODUCT_ROWS`` pairs, which are counted before."""
        few, many = sorted((a.count(), b.count()))
        if few * many > PRODUCT_ROWS:
            raise SparqlError(f"parts of the pattern share no variable: {few} x {many} solutions")
        return a.crossJoin(b)

    @staticmethod
    def divided(a: Rel, b: Rel, shared: list[str]) -> Iterator[tuple[DataFrame, DataFrame, list[str]]]:
        """Both sides by which of the shared variables are bound, and the variables bound in both: each two rows meet
        in one of the parts, where they are compatible if they are equal in these variables."""

        def parts(r: Rel) -> Iterator[tuple[DataFrame, set[str]]]:
            open_ = [n for n in shared if not r.sure[n]]
            for mask in range(1 << len(open_)):
                bound = {n for k, n in enumerate(open_) if mask >> k & 1}
                df = r.df
                for n in open_:
                    df = df.filter(F.col(n).isNotNull() if n in bound else F.col(n).isNull())
                yield df, bound | {n for n in shared if r.sure[n]}

        for da, in_a in parts(a):
            for db, in_b in parts(b):
                yield da, db, [n for n in shared if n in in_a and n in in_b]

    def compatible(self, a: Rel, b: Rel, shared: list[str], keep: list[str]) -> DataFrame:
        """Pairs of compatible rows with the columns ``keep``; each part of the rows is an equi-join."""
        out = []
        for da, db, on in self.divided(a, b, shared):
            right = db.select(*[F.col(n).alias(f"__r_{n}") if n in shared and n not in on else F.col(n) for n in b.names])
            both = da.join(right, on) if on else self.product(da, right)
            out.append(both.select(*[F.coalesce(n, f"__r_{n}").alias(n) if n in shared and n not in on else F.col(n) for n in keep]))
        return reduce(DataFrame.unionByName, out)

    def join(self, a: Rel, b: Rel, how: str = "inner", unique: bool = False) -> Rel:
        shared = [n for n in b.names if n in a.sure]
        names = list(dict.fromkeys(a.names + b.names))
        if not shared and how == "inner":
            one = not a.names or not b.names  # no variables: one solution or none
            return Rel(a.df.crossJoin(b.df) if one else self.product(a.df, b.df), a.sure | b.sure)
        if shared and all(a.sure[n] and b.sure[n] for n in shared):
            if how == "inner" and unique and set(b.names) <= set(a.names):
                return Rel(a.df.join(b.raw if b.raw is not None else b.df, shared, "left_semi"), a.sure)
            df = a.df.join(b.df, shared, how)
            return Rel(df.select(*names), a.sure | {n: s and how == "inner" for n, s in b.sure.items() if n not in a.sure})
        sure = {n: (a.sure.get(n, False) or (b.sure.get(n, False) and how == "inner")) for n in names}
        if how == "inner":
            return Rel(self.compatible(a, b, shared, names), sure)
        # rows of the left side without a match stay as they are; they are told apart by a number that is written down
        rows = cut(a.df.withColumn("__row", F.monotonically_increasing_id()))
        numbered = Rel(rows, a.sure | {"__row": True})
        met = cut(self.compatible(numbered, b, shared, ["__row", *names]))
        alone = rows.join(met.select("__row").distinct(), "__row", "left_anti")
        alone = alone.select(*[F.col(n) if n in a.sure else F.lit(None).cast("string").alias(n) for n in names])
        return Rel(met.drop("__row").unionByName(alone), sure)

    def rel(self, node, given: Rel | None = None) -> Rel:
        if isinstance(node, Bgp):
            return self.bgp(node)
        if isinstance(node, Join):
            if isinstance(node.left, Bgp) and isinstance(node.right, Bgp):
                return self.bgp(Bgp([*node.left.patterns, *node.right.patterns]))
            left = self.rel(node.left)
            if isinstance(node.right, Bgp):  # paths on the right start from what the left has bound
                return self.bgp(node.right, left if left.names else None) if all(left.sure.values()) else self.join(left, self.bgp(node.right))
            if isinstance(node.left, Values) or not isinstance(node.right, Values):
                return self.join(left, self.rel(node.right))
            return self.join(self.rel(node.right), left)
        if isinstance(node, LeftJoin):
            cond = None
            right = node.right
            if isinstance(right, Filter):
                cond, right = right.expr, right.node
            a, b = self.rel(node.left), self.rel(right)
            if cond is None:
                return self.join(a, b, "left")
            key = "__row"
            numbered = Rel(cut(a.df.withColumn(key, F.monotonically_increasing_id())), a.sure)
            both = self.join(Rel(numbered.df, a.sure | {key: True}), b)
            kept = both.df.filter(self.truth(cond, both))
            fresh = [n for n in b.names if n not in a.sure]
            df = numbered.df.join(kept.select(key, *fresh), key, "left").drop(key)
            return Rel(df, a.sure | dict.fromkeys(fresh, False))
        if isinstance(node, Union):
            arms = [self.rel(a) for a in node.arms]
            names = list(dict.fromkeys(n for a in arms for n in a.names))
            df = reduce(lambda x, y: x.unionByName(y), [a.df.select(*[F.col(n) if n in a.sure else F.lit(None).cast("string").alias(n) for n in names]) for a in arms])
            return Rel(df, {n: all(a.sure.get(n, False) for a in arms) for n in names})
        if isinstance(node, Minus):
            return self.anti(self.rel(node.left), self.rel(node.right))
        if isinstance(node, Filter):
            if node.expr[0] == "exists":
                return self.exists(self.rel(node.node), node.expr[1], False)
            if node.expr[0] == "not" and node.expr[1][0] == "exists":
                return self.exists(self.rel(node.node), node.expr[1][1], True)
            r = self.rel(node.node)
            return Rel(r.df.filter(self.truth(node.expr, r)), r.sure)
        if isinstance(node, Extend):
            r = self.rel(node.node)
            return Rel(r.df.withColumn(node.var, self.as_term(self.expr(node.expr, r))), r.sure | {node.var: node.expr[0] == "term"})
        if isinstance(node, Values):
            schema = ", ".join(f"`{n}` string" for n in node.names)
            return Rel(self.spark.createDataFrame([tuple(r) for r in node.rows], schema), {n: all(r[i] is not None for r in node.rows) for i, n in enumerate(node.names)})
        if isinstance(node, Graph):
            return self.graph(node)
        if isinstance(node, Query):
            return self.select(node)
        raise SparqlError(f"cannot plan {type(node).__name__}")

    def graph(self, node: Graph) -> Rel:
        outer = self.scope
        try:
            if not isinstance(node.name, Var):
                self.scope = self.store.graph(node.name)
                return self.rel(node.node)
            # patterns inside one graph: every pattern carries the graph's name and joins on it
            if not isinstance(node.node, Bgp):
                raise SparqlError("GRAPH with a variable takes triple patterns only")
            quads, out = self.store.graph(), None
            for p in node.node.patterns:
                if isinstance(p.p, Path):
                    raise SparqlError("GRAPH with a variable takes no paths")
                df, names = quads, {node.name.name: "g"}
                for c, t in (("s", p.s), ("p", p.p), ("o", p.o)):
                    if isinstance(t, Var):
                        names.setdefault(t.name, c)
                    else:
                        df = df.filter(F.col(c) == t)
                r = Rel(df.select(*[F.col(c).alias(n) for n, c in names.items()]), dict.fromkeys(names, True))
                out = r if out is None else self.join(out, r)
            return out
        finally:
            self.scope = outer

    def anti(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in b.names if n in a.sure]
        if not shared:
            return a
        if all(a.sure[n] and b.sure[n] for n in shared):
            return Rel(a.df.join(b.df.select(*shared).distinct(), shared, "left_anti"), a.sure)
        return Rel(self.without(a, b, shared, False), a.sure)

    def without(self, a: Rel, b: Rel, shared: list[str], unlinked: bool) -> DataFrame:
        """Rows of ``a`` less those a row of ``b`` is compatible with; ``unlinked``: also if they share no bound variable."""
        few = Rel(cut(b.df.select(*shared).distinct()), {n: b.sure[n] for n in shared})
        out: dict[int, DataFrame] = {}
        order: list[DataFrame] = []
        for da, db, on in self.divided(a, few, shared):
            if id(da) not in out:
                order.append(da)
                out[id(da)] = da
            left = out[id(da)]
            if on:
                out[id(da)] = left.join(db.select(*on).distinct(), on, "left_anti")
            elif unlinked and db.limit(1).count():
                out[id(da)] = left.limit(0)
        return reduce(DataFrame.unionByName, [out[id(d)] for d in order])

    def exists(self, a: Rel, node, negated: bool) -> Rel:
        b = self.rel(node)
        shared = [n for n in b.names if n in a.sure]
        how = "left_anti" if negated else "left_semi"
        if not shared:
            return a if bool(b.df.limit(1).count()) != negated else Rel(a.df.limit(0), a.sure)
        if all(a.sure[n] and b.sure[n] for n in shared):
            return Rel(a.df.join(b.df.select(*shared).distinct(), shared, how), a.sure)
        if negated:
            return Rel(self.without(a, b, shared, True), a.sure)
        few = Rel(cut(b.df.select(*shared).distinct()), {n: b.sure[n] for n in shared})
        rows = cut(a.df.withColumn("__row", F.monotonically_increasing_id()))
        out = self.without(Rel(rows, a.sure | {"__row": True}), few, shared, True)
        return Rel(rows.join(out.select("__row"), "__row", "left_anti").drop("__row"), a.sure)

    # ---- expressions -------------------------------------------------------------------------------

    def as_term(self, x: Typed) -> Column:
        if x.kind == "term":
            return x.col
        if x.kind == "str":
            return T.literal(x.col)
        if x.kind == "int":
            return T.integer(x.col)
        if x.kind == "num":
            return F.when(x.col == F.floor(x.col), T.integer(x.col)).otherwise(T.double(x.col))
        return F.when(x.col.isNotNull(), F.concat(F.lit('"'), x.col.cast("string"), F.lit(f'"^^<{T.XSD}boolean>')))

    def as_text(self, x: Typed) -> Column:
        return T.text(x.col) if x.kind == "term" else x.col.cast("string")

    def as_number(self, x: Typed) -> Column:
        return x.col if x.kind in ("num", "int") else T.number(x.col) if x.kind == "term" else x.col.try_cast("double")

    def truth(self, e: tuple, r: Rel) -> Column:
        x = self.expr(e, r)
        if x.kind == "bool":
            return x.col
        if x.kind in ("num", "int"):
            return x.col != 0
        if x.kind == "str":
            return x.col != ""
        n = T.number(x.col)
        return F.when(n.isNotNull(), n != 0).when(T.datatype(x.col) == f"<{T.XSD}boolean>", T.text(x.col) == "true").otherwise(T.text(x.col) != "")

    def expr(self, e: tuple, r: Rel) -> Typed:
        op = e[0]
        if op == "var":
            return Typed("term", F.col(e[1]) if e[1] in r.sure else F.lit(None).cast("string"))
        if op == "term":
            if isinstance(e[1], Var):
                return self.expr(("var", e[1].name), r)
            return Typed("term", F.lit(e[1]))
        if op == "col":
            return Typed(e[2], F.col(e[1]))
        if op in ("and", "or"):
            a, b = self.truth(e[1], r), self.truth(e[2], r)
            return Typed("bool", a & b if op == "and" else a | b)
        if op == "not":
            return Typed("bool", ~self.truth(e[1], r))
        if op == "neg":
            return Typed("num", -self.as_number(self.expr(e[1], r)))
        if op in ("+", "-", "*", "/"):
            a, b = self.as_number(self.expr(e[1], r)), self.as_number(self.expr(e[2], r))
            return Typed("num", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return Typed("bool", self.compare(op, self.expr(e[1], r), self.expr(e[2], r)))
        if op == "in":
            a = self.expr(e[1], r)
            return Typed("bool", reduce(lambda x, y: x | y, [self.compare("=", a, self.expr(x, r)) for x in e[2]], F.lit(False)))
        if op == "call":
            return self.call(e[1], e[2], r)
        raise SparqlError(f"cannot evaluate {op}")

    def compare(self, op: str, a: Typed, b: Typed) -> Column:
        do = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if a.kind in ("num", "int") or b.kind in ("num", "int"):
            return do(self.as_number(a), self.as_number(b))
        x, y = self.as_number(a), self.as_number(b)
        plain = do(self.as_term(a), self.as_term(b)) if op in ("=", "!=") else do(self.as_text(a), self.as_text(b))
        return F.when(x.isNotNull() & y.isNotNull(), do(x, y)).otherwise(plain)

    def call(self, name: str, args: list, r: Rel) -> Typed:
        if name == "BOUND":
            return Typed("bool", self.expr(args[0], r).col.isNotNull())
        x = [self.expr(a, r) for a in args]
        if name == "COALESCE":
            return Typed("term", F.coalesce(*map(self.as_term, x)))
        if name == "IF":
            return Typed("term", F.when(self.truth(args[0], r), self.as_term(x[1])).otherwise(self.as_term(x[2])))
        text = [self.as_text(a) for a in x]
        if name == "STR":
            return Typed("str", text[0])
        if name in ("REPLACE", "REGEX"):
            flags = args[3 if name == "REPLACE" else 2][1] if len(args) > (3 if name == "REPLACE" else 2) else '""'
            pattern = self.constant(args[1])
            mode = "".join(f for f in flags.strip('"') if f in "ims")
            pattern = f"(?{mode}){pattern}" if mode else pattern
            if name == "REGEX":
                return Typed("bool", text[0].rlike(pattern))
            return Typed("str", F.regexp_replace(text[0], pattern, self.constant(args[2])))
        if name == "LANG":
            return Typed("str", T.lang(x[0].col))
        if name == "LANGMATCHES":
            return Typed("bool", (F.lower(text[0]) == F.lower(text[1])) | ((text[1] == "*") & (text[0] != "")) | F.startswith(F.lower(text[0]), F.concat(F.lower(text[1]), F.lit("-"))))
        if name == "DATATYPE":
            return Typed("term", T.datatype(self.as_term(x[0])))
        if name in ("ISIRI", "ISURI"):
            return Typed("bool", T.is_iri(x[0].col))
        if name == "ISLITERAL":
            return Typed("bool", T.is_literal(self.as_term(x[0])))
        if name == "ISBLANK":
            return Typed("bool", T.is_bnode(self.as_term(x[0])))
        if name == "ISNUMERIC":
            return Typed("bool", self.as_number(x[0]).isNotNull())
        if name in ("IRI", "URI"):
            return Typed("term", T.iri(text[0]))
        if name == "SAMETERM":
            return Typed("bool", self.as_term(x[0]) == self.as_term(x[1]))
        if name == "SUBSTR":
            start = self.as_number(x[1]).cast("int")
            return Typed("str", F.substring(text[0], start, self.as_number(x[2]).cast("int") if len(x) > 2 else F.length(text[0])))
        simple = {
            "CONTAINS": ("bool", lambda: F.contains(text[0], text[1])),
            "STRSTARTS": ("bool", lambda: F.startswith(text[0], text[1])),
            "STRENDS": ("bool", lambda: F.endswith(text[0], text[1])),
            "STRLEN": ("int", lambda: F.length(text[0]).cast("bigint")),
            "UCASE": ("str", lambda: F.upper(text[0])),
            "LCASE": ("str", lambda: F.lower(text[0])),
            "CONCAT": ("str", lambda: F.concat(*text)),
            "STRAFTER": ("str", lambda: F.when(F.contains(text[0], text[1]), F.substring(text[0], F.instr(text[0], text[1]) + F.length(text[1]), F.length(text[0]))).otherwise("")),
            "STRBEFORE": ("str", lambda: F.when(F.contains(text[0], text[1]), F.substring(text[0], F.lit(1), F.instr(text[0], text[1]) - 1)).otherwise("")),
            "ABS": ("num", lambda: F.abs(self.as_number(x[0]))),
            "CEIL": ("num", lambda: F.ceil(self.as_number(x[0])).cast("double")),
            "FLOOR": ("num", lambda: F.floor(self.as_number(x[0])).cast("double")),
            "ROUND": ("num", lambda: F.floor(self.as_number(x[0]) + 0.5).cast("double")),
        }
        if name not in simple:
            raise SparqlError(f"unknown function {name}")
        kind, make = simple[name]
        return Typed(kind, make())

    def constant(self, e: tuple) -> str:
        if e[0] != "term" or not e[1].startswith('"'):
            raise SparqlError("a pattern must be a string")
        return e[1][1 : e[1].rindex('"')].replace('\\"', '"').replace("\\\\", "\\")

    # ---- solution modifiers ------------------------------------------------------------------------

    def aggregate(self, e: tuple, r: Rel, out: dict[str, tuple[Column, str]]) -> tuple:
        """Replaces aggregates by columns computed with the grouping; returns the rest of the expression."""
        if isinstance(e, tuple) and e and e[0] == "agg":
            _, name, distinct, arg, sep = e
            x = self.expr(arg, r) if arg is not None else None
            key = f"__a{len(out)}"
            if name == "COUNT":
                c = F.lit(1) if x is None else self.as_term(x)
                col, kind = (F.count_distinct(c) if distinct and x is not None else F.count(c)).cast("bigint"), "int"
            elif name == "GROUP_CONCAT":
                bag = F.collect_set(self.as_text(x)) if distinct else F.collect_list(self.as_text(x))
                col, kind = F.array_join(F.array_sort(bag), sep), "str"
            elif name == "SAMPLE":
                col, kind = F.min(self.as_term(x)), "term"
            elif name in ("SUM", "AVG"):
                n = self.as_number(x)
                col, kind = (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n), "num"
                col = F.coalesce(col, F.lit(0.0))
            else:
                do = F.min if name == "MIN" else F.max
                col, kind = F.coalesce(self.as_term(Typed("num", do(self.as_number(x)))), do(self.as_term(x))), "term"
            out[key] = (col, kind)
            return ("col", key, kind)
        if isinstance(e, tuple):
            return tuple(self.aggregate(p, r, out) if isinstance(p, tuple) else [self.aggregate(i, r, out) for i in p] if isinstance(p, list) else p for p in e)
        return e

    def select(self, q: Query, native: bool = False) -> Rel:
        r = self.rel(q.where)
        projection = q.projection or [(n, None) for n in r.names if not n.startswith("__")]
        has_agg = bool(q.group) or any(_has_aggregate(e) for _, e in projection) or any(map(_has_aggregate, q.having))
        having, order = list(q.having), list(q.order)
        if has_agg:
            keys = {n: self.as_term(self.expr(e, r)) for n, e in q.group}
            aggs: dict[str, tuple[Column, str]] = {}
            projection = [(n, self.aggregate(e, r, aggs) if e is not None else None) for n, e in projection]
            having = [self.aggregate(e, r, aggs) for e in having]
            order = [(self.aggregate(e, r, aggs), d) for e, d in order]
            grouped = r.df.groupBy(*[c.alias(n) for n, c in keys.items()])
            df = grouped.agg(*[c.alias(k) for k, (c, _) in aggs.items()]) if aggs else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
            r = Rel(df, dict.fromkeys(keys, True))
        for e in having:
            r = Rel(r.df.filter(self.truth(e, r)), r.sure)
        kinds: dict[str, str] = {}
        df = r.df
        for n, e in projection:
            if e is not None:
                x = self.expr(e, r)
                kinds[n] = x.kind
                df = df.withColumn(n, x.col if native and x.kind != "term" else self.as_term(x))
                r = Rel(df, r.sure | {n: False})
        names = [n for n, _ in projection]
        missing = [n for n in names if n not in df.columns]
        for n in missing:
            df = df.withColumn(n, F.lit(None).cast("string"))
        keep: list[Column] = []
        if order and not q.distinct:
            for e, down in order:
                x = self.expr(("col", e[1], kinds[e[1]]), r) if e[0] == "var" and native and kinds.get(e[1], "term") != "term" else self.expr(e, r)
                parts = [x.col] if x.kind != "term" else [T.number(x.col), x.col]
                keep += [p.desc() if down else p.asc() for p in parts]
            # equal rows in no order, so the result of a slice is defined
            df = df.orderBy(*keep, *names).select(*names)
        else:
            df = df.select(*names)
            if q.distinct:
                df = df.distinct()
            if order:
                for e, down in order:
                    x = self.expr(e, Rel(df, dict.fromkeys(names, False)))
                    parts = [x.col] if x.kind != "term" or (native and kinds.get(e[1]) not in (None, "term")) else [T.number(x.col), x.col]
                    keep += [p.desc() if down else p.asc() for p in parts]
                df = df.orderBy(*keep, *names)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rel(df, {n: r.sure.get(n, False) for n in names})


def _has_aggregate(e) -> bool:
    if isinstance(e, tuple):
        return bool(e) and e[0] == "agg" or any(_has_aggregate(x) for x in e)
    return isinstance(e, list) and any(map(_has_aggregate, e))


def run(store, query: str | Query, encoded: bool = False, prefixes: dict[str, str] | None = None) -> DataFrame | bool:
    """The result of a query: a DataFrame, or a boolean for ASK.

    Solutions are plain values (text of IRIs and literals, numbers of aggregates) unless ``encoded``; CONSTRUCT
    and DESCRIBE give distinct (s, p, o) triples. An unbound variable is null.
    """
    q = parse(query, prefixes) if isinstance(query, str) else query
    planner = Planner(store)
    if q.kind == "ask":
        return planner.rel(q.where).df.limit(1).count() > 0
    if q.kind == "construct":
        r = planner.rel(q.where)
        term = lambda t: F.col(t.name) if isinstance(t, Var) else F.lit(t)
        rows = F.explode(F.array(*[F.struct(term(p.s).alias("s"), term(p.p).alias("p"), term(p.o).alias("o")) for p in q.template]))
        return r.df.select(rows.alias("t")).select("t.*").dropna().filter(~T.is_literal("s")).distinct()
    if q.kind == "describe":
        triples = store.triples()
        fixed = [e[1] for _, e in q.projection if e is not None]
        found = planner.spark.createDataFrame([(t,) for t in fixed], "s string")
        names = [n for n, e in q.projection if e is None]
        if q.where is not None and names:
            r = planner.rel(q.where).df
            for n in names:
                found = found.unionByName(r.select(F.col(n).alias("s")))
        return triples.join(found.dropna().distinct(), "s", "left_semi")
    rel = planner.select(q, native=not encoded)
    if encoded:
        return rel.df
    return rel.df.select(*[T.text(n).alias(n) if t == "string" and _is_term_column(q, n) else F.col(n) for n, t in rel.df.dtypes])


def _is_term_column(q: Query, name: str) -> bool:
    for n, e in q.projection:
        if n == name and e is not None:
            return not (e[0] == "agg" and e[1] in ("GROUP_CONCAT", "COUNT", "SUM", "AVG")) and not (e[0] == "call" and e[1] not in ("COALESCE", "IF", "IRI", "URI", "DATATYPE"))
    return True
