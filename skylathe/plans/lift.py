"""Tables lifted into triples. Each function gives (s, p, o) as a set; all of it is projection, explode and joins.

A row gives several triples through one ``explode`` of an array of structs, so a table is read once. Incomplete
rows give the triples whose parts are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import BASE, DC, RDF, RDFS, iri, literal, slug

TYPE, LABEL, SUBCLASS = f"<{RDF}type>", f"<{RDFS}label>", f"<{RDFS}subClassOf>"
DESCRIPTION = f"<{DC}description>"


def name(local: str, base: str = BASE) -> str:
    return f"<{base}{local}>"


def node(c: Column, base: str = BASE) -> Column:
    """The IRI of a label; null for one without a word character."""
    return F.when(c.rlike(r"(?U)[\w-]"), iri(F.concat(F.lit(base), slug(c))))


def _emit(df: DataFrame, *triples: tuple) -> DataFrame:
    term = lambda x: F.lit(x) if isinstance(x, str) else x
    rows = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in triples])
    return df.select(F.explode(rows).alias("t")).select("t.*").dropna()


def lift_troubleshooting(df: DataFrame, trouble: str = "TROUBLE", cause: str = "PROBABLE CAUSE", remedy: str = "REMEDY", base: str = BASE) -> DataFrame:
    """Problems with their causes, and remedies that address them."""
    t, c, r = (node(F.col(f"`{x}`"), base) for x in (trouble, cause, remedy))
    labels = [literal(F.col(f"`{x}`")) for x in (trouble, cause, remedy)]
    n = lambda x: name(x, base)
    return _emit(
        df,
        (t, TYPE, n("Problem")), (t, LABEL, labels[0]), (t, n("hasCause"), c),
        (c, TYPE, n("Cause")), (c, LABEL, labels[1]),
        (r, TYPE, n("Remedy")), (r, LABEL, labels[2]), (r, n("addresses"), t),
    ).distinct()


def lift_part_classes(df: DataFrame, part: str = "Part", parent: str = "subClassOf", base: str = BASE) -> DataFrame:
    """Part classes with their superclasses; classes without one are parts."""
    p, s = node(F.col(part), base), node(F.col(parent), base)
    own = _emit(df, (p, TYPE, name("Part", base)), (p, LABEL, literal(F.col(part))), (p, SUBCLASS, s), (s, LABEL, literal(F.col(parent))))
    return own.distinct()


def lift_catalog(df: DataFrame, classes: DataFrame | None = None, section="Section", figure="Figure", number="Part Number", kind="Type", specifics="Specifics", base: str = BASE, compat_nan_label: bool = False) -> DataFrame:
    """Systems, assemblies and part instances. A part is part of its assembly and of its system.

    A part without specifics is labelled by its type; with ``compat_nan_label`` by the double NaN. The chain
    of superclasses of every type used is closed up to Part (``classes``: Part, subClassOf).
    """
    col = lambda x: F.col(f"`{x}`")
    sys_, asm, cls = node(col(section), base), node(col(figure), base), node(col(kind), base)
    part = F.when(F.trim(col(number)) != "", iri(F.concat(F.lit(base + "partnr-"), col(number))))
    given = F.when(F.trim(col(specifics)) != "", literal(col(specifics)))
    label = F.coalesce(given, F.lit('"NaN"^^<http://www.w3.org/2001/XMLSchema#double>') if compat_nan_label else literal(col(kind)))
    n = lambda x: name(x, base)
    own = _emit(
        df,
        (sys_, TYPE, n("System")), (sys_, LABEL, literal(col(section))),
        (asm, TYPE, n("Assembly")), (asm, LABEL, literal(col(figure))), (asm, n("partOf"), sys_),
        (part, TYPE, n("PartInstance")), (part, LABEL, label), (part, n("partNumber"), literal(col(number))),
        (part, n("partOf"), asm), (part, n("partOf"), sys_), (part, SUBCLASS, cls),
    )
    used = df.select(cls.alias("c")).dropna().distinct()
    if classes is None:
        top = used
        chain = None
    else:
        from ..operators.closure import superclasses

        links = classes.select(node(F.col("Part"), base).alias("s"), node(F.col("subClassOf"), base).alias("o")).dropna().distinct()
        up = superclasses(links)
        above = used.join(up.select(F.col("s").alias("c"), F.col("o").alias("a")), "c").select(F.col("a").alias("c")).unionByName(used).distinct()
        chain = above.join(links.select(F.col("s").alias("c"), "o"), "c").select(F.col("c").alias("s"), F.lit(SUBCLASS).alias("p"), "o")
        top = above.join(links.select(F.col("s").alias("c")), "c", "left_anti")
    own = own.unionByName(top.select(F.col("c").alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(n("Part")).alias("o")))
    return (own.unionByName(chain) if chain is not None else own).distinct()


def lift_functions(functions: DataFrame, subfunctions: DataFrame, depends: DataFrame, problems: DataFrame | None = None, base: str = BASE) -> DataFrame:
    """Components with their functions, the hierarchy of functions and what depends on what.

    ``functions``: component, has_function. ``subfunctions``: sub_function_of, function_name. ``depends``:
    component, depends_on. ``problems``: defines, function_of, function_name. Where one component depends on
    another, each of its functions depends on each of the other's.
    """
    n = lambda x: name(x, base)
    fun = lambda c: ((node(F.col(c), base), TYPE, n("Function")), (node(F.col(c), base), LABEL, literal(F.col(c))))
    comp, has = node(F.col("component"), base), node(F.col("has_function"), base)
    out = _emit(functions, *fun("has_function"), (comp, n("hasFunction"), has))
    out = out.unionByName(_emit(subfunctions, *fun("sub_function_of"), *fun("function_name"), (node(F.col("function_name"), base), n("subFunctionOf"), node(F.col("sub_function_of"), base))))
    dep = depends.select(comp.alias("a"), node(F.col("depends_on"), base).alias("b")).dropna().distinct()
    out = out.unionByName(_emit(dep, (F.col("a"), n("dependsOn"), F.col("b"))))
    owns = functions.select(comp.alias("c"), has.alias("f")).dropna().distinct()
    if problems is not None:
        prob, of, f = (node(F.col(c), base) for c in ("defines", "function_of", "function_name"))
        out = out.unionByName(
            _emit(
                problems, *fun("function_name"), (prob, TYPE, n("Problem")), (prob, LABEL, literal(F.col("defines"))),
                (of, TYPE, n("Component")), (of, LABEL, literal(F.col("function_of"))), (of, n("hasFunction"), f), (f, n("addressesProblem"), prob),
            )
        )
        owns = owns.unionByName(problems.select(of.alias("c"), f.alias("f")).dropna()).distinct()
    return out.unionByName(function_dependencies(owns, dep, base)).distinct()


def function_dependencies(owns: DataFrame, dep: DataFrame, base: str = BASE) -> DataFrame:
    """(s, p, o): functions of a component depend on the functions of the components it depends on."""
    left = dep.join(owns.select(F.col("c").alias("a"), F.col("f").alias("s")), "a").select("s", "b").distinct()
    return left.join(owns.select(F.col("c").alias("b"), F.col("f").alias("o")), "b").select("s", F.lit(name("dependsOn", base)).alias("p"), "o").distinct()


def log_index(logs: DataFrame, ident: str = "ident", order: str = "row_id") -> DataFrame:
    """One row per identifier: the last by ``order``. Grouped by partial aggregation, so a hot one is no burden."""
    rest = [c for c in logs.columns if c != ident]
    return logs.groupBy(ident).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(ident, "r.*")


def lift_events(rows: DataFrame, logs: DataFrame, kind: str, base: str = BASE) -> DataFrame:
    """Events of extracted rows (id, part, cylinders, engine and a column named as the kind: problem or action).

    ``logs`` has ident, problem and action, one row per ident (``log_index``). A row without a log record gives
    no event; an action still deals with its problem, from the node action-unknown.
    """
    n = lambda x: name(x, base)
    state_col, title = F.col(kind), kind.title()
    idx = logs.select(F.col("ident").alias("id"), F.lit(True).alias("found"), F.col(kind).alias("log_text"))
    df = rows.select("id", "part", "cylinders", "engine", kind).join(idx, "id", "left")
    found = F.coalesce("found", F.lit(False))
    ev = F.when(found, iri(F.concat(F.lit(f"{base}{kind}-"), F.col("id"))))
    filled = lambda c: F.when(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) != "", F.trim(c))
    state = F.when(found & (state_col != ""), node(F.concat(state_col, F.lit(f" {kind}")), base))
    part, engine = F.when(found, filled(F.col("part"))), F.when(found, filled(F.col("engine")))
    cyl = F.when(found & (F.col("cylinders") != ""), F.col("cylinders"))
    engine_node = node(F.concat(F.lit("Engine "), engine), base)
    triples = [
        (ev, TYPE, n(title)), (ev, LABEL, literal(F.concat(F.lit(f"{title} "), F.col("id")))), (ev, DESCRIPTION, literal(F.col("log_text"), lang="en")),
        (ev, TYPE, state), (state, SUBCLASS, n(title)), (state, LABEL, literal(state_col)),
        (ev, n("involves"), node(part, base)), (node(part, base), LABEL, literal(part)),
        (ev, n("location"), literal(cyl)), (ev, n("location"), literal(engine)),
        (ev, n("atLocation"), engine_node), (engine_node, LABEL, literal(F.concat(F.lit("Engine "), engine))), (engine_node, TYPE, n("Location")),
    ]
    if kind == "action":
        triples.append((F.coalesce(ev, F.lit(n("action-unknown"))), n("dealsWith"), iri(F.concat(F.lit(f"{base}problem-"), F.col("id")))))
    out = _emit(df, *triples)
    digits = F.explode(F.array_distinct(F.regexp_extract_all(cyl, F.lit(r"(\d+)"), 1)))
    at = df.select(ev.alias("ev"), digits.alias("d"))
    loc, label = node(F.concat(F.lit("Cylinder "), F.col("d")), base), literal(F.concat(F.lit("Cylinder "), F.col("d")))
    return out.unionByName(_emit(at, (F.col("ev"), n("atLocation"), loc), (loc, LABEL, label), (loc, TYPE, n("Location")))).distinct()


def as_quads(triples: DataFrame, graph: str) -> DataFrame:
    return triples.select(F.lit(f"<{graph}>").alias("g"), "s", "p", "o")
