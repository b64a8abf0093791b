"""Queries on sources and sinks (tables written and read back), mapping sets, lifts with all their parts, checks,
reports and keys, with their SQL. What is written lies in the shared folder, as intermediate tables do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kg_queries as K
from . import op_queries as O
from .functions.terms import BASE, text
from .kg import Maintenance
from .kg_queries import _node, with_
from .operators import linking as L
from .operators import retrieval as R
from .operators import scoring as S
from .operators.tagging import annotate
from .operators.validation import Property, Shape, violations
from .plans import lift, report
from .plans.planner import run
from .plans.store import QuadStore
from .session import put_text, scratch, table
from .sources import rdf, sinks, tables

GRAPHS = ("<https://example.org/g/functions>", "<https://example.org/g/all>")


def _plain(df: DataFrame) -> DataFrame:
    """Terms as IRIs or texts."""
    return df.select(*[text(c).alias(c) for c in df.columns])


# ---- tables ------------------------------------------------------------------------------------------------


def _catalog_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "parts_catalog").select("row_id", "section_name", "figure", "figure_item", "part_number", "part_type", "specifics"), path)
    return path


def io_csv(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_csv(spark, _catalog_file(spark, d))


def io_csv_types(spark: SparkSession, d: str) -> DataFrame:
    """Types are inferred: what was a whole number is one again."""
    df = tables.read_csv(spark, _catalog_file(spark, d), infer=True)
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), (F.col("figure_item") + 1).alias("next_item"), "part_number")


def _functions_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark)
    sinks.write_csv(table(spark, d, "component_functions").select("row_id", "component", "has_function"), path, "\t")
    return path


def io_tsv(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_tsv(spark, _functions_file(spark, d), ["row_id", "component", "has_function"])


def io_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_empty(tables.read_tsv(spark, _functions_file(spark, d)))


# ---- graphs ------------------------------------------------------------------------------------------------


def _owns(m: Maintenance) -> DataFrame:
    return m.has_function().select("s", F.lit(lift.name("hasFunction")).alias("p"), "o").distinct()


def _needs(m: Maintenance) -> DataFrame:
    return m.component_dependencies().select("s", F.lit(lift.name("componentDependsOn")).alias("p"), "o")


def _triples_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark)
    sinks.write_ntriples(_owns(Maintenance(spark, d)), path)
    return path


def io_ntriples(spark: SparkSession, d: str) -> DataFrame:
    return _plain(rdf.read_ntriples(spark, _triples_file(spark, d)))


def io_turtle(spark: SparkSession, d: str) -> DataFrame:
    return _plain(rdf.read_files(spark, [_triples_file(spark, d)]).select("s", "p", "o"))


def _quads_file(spark: SparkSession, d: str) -> str:
    m, path = Maintenance(spark, d), scratch(spark)
    own = _owns(m)
    both = own.unionByName(_needs(m))
    sinks.write_trig(own.select(F.lit(GRAPHS[0]).alias("g"), "s", "p", "o").unionByName(both.select(F.lit(GRAPHS[1]).alias("g"), "s", "p", "o")), path)
    return path


def io_trig(spark: SparkSession, d: str) -> DataFrame:
    return _plain(rdf.read_files(spark, [_quads_file(spark, d)]))


def io_one_graph(spark: SparkSession, d: str) -> DataFrame:
    return _plain(QuadStore(rdf.read_files(spark, [_quads_file(spark, d)])).graph(GRAPHS[0]))


def io_union_of_graphs(spark: SparkSession, d: str) -> DataFrame:
    return _plain(QuadStore(rdf.read_files(spark, [_quads_file(spark, d)])).triples())


def _region_files(spark: SparkSession, d: str) -> str:
    """A Turtle file for each of the five regions, every second one under the prefix old-, and one that is broken."""
    folder = scratch(spark)
    for r in table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").limit(5).collect():
        body = f'@prefix : <{BASE}> .\n:region{r["r_regionkey"]} a :Region ; :name "{r["r_name"]}" .\n'
        put_text(spark, f"{folder}/{'old-' if r['r_regionkey'] % 2 else ''}{r['r_name'].lower().replace(' ', '-')}.ttl", body)
    put_text(spark, f"{folder}/broken.ttl", f"<{BASE}a> <{BASE}b>")
    put_text(spark, f"{folder}/notes.txt", "no graph")
    return folder


def io_directory(spark: SparkSession, d: str) -> DataFrame:
    return _plain(rdf.read_directory(spark, _region_files(spark, d)).select("s", "p", "o"))


def io_directory_less_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _plain(rdf.read_directory(spark, _region_files(spark, d), exclude_prefix="old-").select("s", "p", "o"))


def io_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Lines and nodes by predicate of a graph of blank nodes, one a row of the table, many of them alike."""
    rows = table(spark, d, "component_functions").filter("component IS NOT NULL AND has_function IS NOT NULL")
    node = F.concat(F.lit("_:r"), "row_id")
    lit = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    both = [rows.select(node.alias("s"), F.lit(f"<{BASE}{c}>").alias("p"), lit(c).alias("o")) for c in ("component", "has_function")]
    lines = sinks.canonical_lines(both[0].unionByName(both[1]))
    parts = lines.select(F.regexp_extract("line", r"^(\S+)", 1).alias("node"), F.regexp_extract("line", r"#(\w+)>", 1).alias("predicate"))
    return parts.groupBy("predicate").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("node").alias("n_nodes"))


def io_catalog(spark: SparkSession, d: str) -> DataFrame:
    names = [r["r_name"].lower() for r in table(spark, d, "region").select("r_name").orderBy("r_regionkey").limit(5).collect()]
    catalog = sinks.data_catalog([f"{n}.ttl" for n in names] + ["notes.csv"], "https://example.org/data/", "regions")
    path = scratch(spark)
    spark.createDataFrame([(json.dumps(catalog),)], "value string").write.text(path)
    return tables.read_catalog(spark, path)


# ---- mapping sets ------------------------------------------------------------------------------------------


def _mappings(spark: SparkSession, d: str) -> DataFrame:
    cat = O._catalog(spark, d)
    return L.mapping_rows(L.link(L.mentions(table(spark, d, O.EXT)), cat), cat, "tool 1", "catalog.csv", "abc", "2024-01-01")


def io_sssom(spark: SparkSession, d: str) -> DataFrame:
    """A mapping set written and read back: ids, labels and confidence of each mapping."""
    path = scratch(spark)
    rows = _mappings(spark, d)
    sinks.write_sssom(rows, path, {"license": "x"})
    cells = F.split("value", "\t", -1)
    lines = spark.read.text(path).filter(~F.col("value").rlike("^(#|mapping_id\t)"))
    back = lines.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(rows.columns)])
    return back.select("mapping_id", "subject_id", "object_id", "object_label", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "mapping_date", "mapping_notes")


def io_sssom_rdf(spark: SparkSession, d: str) -> DataFrame:
    q = sinks.mapping_quads(_mappings(spark, d), BASE, GRAPHS[0][1:-1], "2024-01-01T00:00:00Z")
    kinds = q.select(F.regexp_extract("p", r"[#/](\w+)>$", 1).alias("predicate")).filter("predicate IN ('relatedMatch', 'annotatedSource', 'type', 'wasGeneratedBy')")
    return kinds.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def link_simplified(spark: SparkSession, d: str) -> DataFrame:
    out = L.simplify(L.link(L.mentions(table(spark, d, O.EXT)), O._catalog(spark, d)))
    return out.select("mention", "part_number", F.round("confidence", 4).alias("confidence"))


#: Words of the language that a caller may want left out.
STOP = "a an and are as at be by for from has in is it of on or not that the to was with see used all".split()


def link_idf_stop(spark: SparkSession, d: str) -> DataFrame:
    return L.idf(O._catalog(spark, d), STOP).select("term", F.round("idf", 6).alias("idf"))


# ---- lifts and checks --------------------------------------------------------------------------------------


def kg_trouble_lift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, O.LOG).select(F.col("problem").alias("TROUBLE"), F.col("location").alias("PROBABLE CAUSE"), F.col("action").alias("REMEDY"))
    return _plain(lift.lift_troubleshooting(rows))


def kg_parts_lift_classes(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with the chain of superclasses of its types."""
    kinds = table(spark, d, "canonical_items").filter("list_name = 'part_type'").select(F.col("label").alias("Part"), F.element_at(F.split("label", " "), -1).alias("subClassOf")).filter("Part <> subClassOf")
    up = kinds.select(F.col("subClassOf").alias("Part"), F.lit("HARDWARE").alias("subClassOf"))
    return _plain(lift.lift_catalog(table(spark, d, "parts_catalog"), kinds.unionByName(up), "section_name", "figure", "part_number", "part_type", "specifics"))


def kg_action_lift(spark: SparkSession, d: str) -> DataFrame:
    logs = lift.log_index(table(spark, d, O.LOG).filter("ident is not null").select("ident", "problem", "action", "row_id"))
    rows = Maintenance(spark, d).actions.select("id", "part", "cylinders", F.lit("left").alias("engine"), "action")
    return _plain(lift.lift_events(rows, logs, "action"))


def kg_literal_seeds(spark: SparkSession, d: str) -> DataFrame:
    numbers = Maintenance(spark, d).part_number().select("s", F.lit(lift.name("partNumber")).alias("p"), "o")
    return R.literal_seeds(numbers, 'SELECT ?p { ?p :partNumber "ZK-03516377-61" }').select(text("seed").alias("seed"))


def kg_retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, R.retrieval_text(O._SEEDS, k)) for k in (1, 2)], "depth int, line string")


def kg_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = Maintenance(spark, d)
    t = m.type().select("s", F.lit(lift.TYPE).alias("p"), "o").unionByName(_owns(m)).unionByName(_needs(m)).distinct()
    shape = Shape(lift.name("Component"), [Property(lift.name("hasFunction"), cls=lift.name("Function"), most=1), Property(lift.name("componentDependsOn"), cls=lift.name("Component"))])
    out = violations(t, [shape])
    return out.select(text("node").alias("node"), text("path").alias("path"), text("value").alias("value"), "rule")


def kg_count_by_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """The third key is not bound in every solution."""
    q = "SELECT ?type ?part ?l (COUNT(?problem) AS ?n) WHERE { ?problem rdf:type ?type ; :involves ?part OPTIONAL { ?part rdfs:label ?l } } GROUP BY ?type ?part ?l ORDER BY DESC(?n)"
    return run(Maintenance(spark, d).store(), K.PREFIXES + q)


# ---- replies, scores, keys, reports ------------------------------------------------------------------------


def json_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of fenced JSON replies."""
    replies = table(spark, d, "events").select("event_id", F.concat(F.lit('```\n{"items": ['), "props", F.lit(', {"k": 0}]}\n```')).alias("reply"))
    return S.parse_records(replies, "reply", "items", "k: bigint", ["event_id"])


def _two_cells(spark: SparkSession, d: str, other: str) -> DataFrame:
    dep = table(spark, d, "dependson").filter("loaded_at IS NOT NULL").withColumn("question", F.concat(F.col("feed"), F.lit(" "), F.date_format("loaded_at", "yyyy-MM")))
    side = lambda c, s: dep.select("question", F.lit(s).alias("side"), F.col("row_id").alias("row_no"), F.array(F.lower(F.trim(c)), F.lit(other if s == "pred" else "x")).alias("cells")).filter("cells[0] IS NOT NULL AND question IS NOT NULL")
    return side("component", "gold").unionByName(side("depends_on", "pred"))


def score_lenient(spark: SparkSession, d: str) -> DataFrame:
    """One of two cells may differ: with unlike second cells the first ones decide, with like ones all rows match."""
    kinds = {"strict": ("y", S.mismatch_budget(2, 0.5)), "loose": ("x", S.mismatch_budget(2, 0.9)), "none": ("y", S.mismatch_budget(2, 0.4))}
    parts = [S.score_lenient(_two_cells(spark, d, other), ["question"], budget).select(F.lit(k).alias("kind"), "question", "tp", "fp", "fn") for k, (other, budget) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def score_mean_of_none(spark: SparkSession, d: str) -> DataFrame:
    """Groups without a value have no mean and no deviation: not a number."""
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "click", F.col("value")).alias("value"))
    m = S.mean_std(e, "value", ["event_type"])
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.isnan("mean").alias("none"), F.isnan("std").alias("no_std"))


def context_hash(spark: SparkSession, d: str) -> DataFrame:
    return sinks.stable_hash(O._around(spark, d))


def price_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = tables.price_table(spark, [("en", 0.000002, 0.0001), ("de", 0.000003, 0.0), ("fr", None, 0.0)])
    doc = table(spark, d, "documents").filter("text is not null").select(F.col("lang").alias("model"), S.estimate_tokens(F.col("text")).alias("tokens"))
    cost = doc.join(prices, "model").select("model", S.request_cost(F.col("tokens"), F.col("prompt_price"), F.col("request_price")).alias("cost"))
    return cost.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost").cast("double"), 6).alias("cost"))


_REPORTED = ("kg_object_join", "kg_values_join", "kg_topk_parts", "kg_bgp_const")


def report_status(spark: SparkSession, d: str) -> DataFrame:
    store = Maintenance(spark, d).store()
    done = [report.execute(store, "kg", n, n, K.PREFIXES + K.SPARQL[n]) for n in _REPORTED] + [report.execute(store, "kg", "broken", "broken", "SELECT ?x {")]
    return spark.createDataFrame([(o.name, o.status, o.rows) for o in done], "name string, status string, n bigint")


def report_chart(spark: SparkSession, d: str) -> DataFrame:
    rows = report.chart_rows(run(Maintenance(spark, d).store(), K.PREFIXES + K.SPARQL["kg_topk_parts"]), top=5)
    return spark.createDataFrame(rows, "label string, value double")


def io_result_form(spark: SparkSession, d: str) -> DataFrame:
    """Solutions written in the JSON result form and read back."""
    path = scratch(spark)
    q = 'SELECT ?f ?l ?none { ?c :hasFunction ?f . ?f rdfs:label ?l OPTIONAL { ?f :nothing ?none } }'
    sinks.write_result(run(Maintenance(spark, d).store(), K.PREFIXES + q, encoded=True), path)
    cell = "struct<type: string, value: string, datatype: string>"
    lines = spark.read.text(path).filter(F.col("value").rlike('^,?[{]"f"'))
    one = F.from_json(F.regexp_replace("value", "^,", ""), f"f {cell}, l {cell}, none {cell}")
    return lines.select(one.alias("r")).select(F.col("r.f.type").alias("kind"), F.col("r.f.value").alias("f"), F.col("r.l.type").alias("l_kind"), F.col("r.l.value").alias("l"), F.col("r.none.value").alias("none"))


def text_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = annotate(table(spark, d, O.LOG)).select("ident", F.explode("spans").alias("s"))
    return a.select("ident", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "s.label")


def cached_replies(spark: SparkSession, d: str) -> DataFrame:
    """Answers by key, else by path: columns that fit first, then as many rows as asked for, then the smallest key."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    path = lambda c: F.col(c).cast("string").alias("path")
    asked = nation.select(F.col("n_name").alias("key"), path("n_regionkey"), F.array(F.lit("name")).alias("columns"), (F.col("n_nationkey") % 3).cast("int").alias("gold_size"))
    held = nation.filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("key"), path("n_regionkey"), F.array(F.lit("other")).alias("columns"), F.array("n_name").alias("rows"))
    more = [region.select(F.concat(F.lit(p), "r_name").alias("key"), path("r_regionkey"), F.array(F.lit("name")).alias("columns"), F.array_repeat("r_name", n).alias("rows")) for p, n in (("y", 1), ("z", 2))]
    out = S.cached_answers(asked, held.unionByName(more[0]).unionByName(more[1]))
    return out.select("key", F.get("answer_columns", F.lit(0)).alias("column"), F.size("answer_rows").alias("n"), F.get("answer_rows", F.lit(0)).alias("first"))


_NAMES = (
    "io_csv io_csv_types io_tsv io_keep_empty io_ntriples io_turtle io_trig io_one_graph io_union_of_graphs io_directory io_directory_less_prefix io_canonical io_catalog io_sssom io_sssom_rdf "
    "link_simplified link_idf_stop kg_trouble_lift kg_parts_lift_classes kg_action_lift kg_literal_seeds kg_retrieval_text kg_shapes kg_count_by_three_keys json_records score_lenient score_mean_of_none "
    "context_hash price_cost report_status report_chart io_result_form text_annotations cached_replies"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ---- SQL ---------------------------------------------------------------------------------------------------

_B = BASE
_HF = f"SELECT s, '{_B}hasFunction' AS p, o FROM hf"
_BOTH = f"{_HF} UNION ALL SELECT s, '{_B}componentDependsOn', o FROM cd"
_REGIONS = f"SELECT '{_B}region' || r_regionkey AS s, unnest(['{O._RDF}type', '{_B}name']) AS p, unnest(['{_B}Region', r_name]) AS o FROM region"
_USLUG = "lower(replace(trim(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '_'))"
_KEPT = f"""{O._SCORE}, od AS (SELECT *, coalesce((score - lead(score) OVER w) / score, 0) > 0.5 AS dropped FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY mention ORDER BY round(score, 12) DESC, row_id)),
 kp AS (SELECT *, coalesce(sum(dropped::INT) OVER (PARTITION BY mention ORDER BY round(score, 12) DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM od),
 lk AS (SELECT mention, part_number, round(min(share), 5) AS confidence FROM (SELECT *, score / sum(score) OVER (PARTITION BY mention) AS share FROM kp WHERE b = 0) GROUP BY ALL),
 fl AS (SELECT part_number, arg_min(trim(trim(coalesce(specifics, '')) || ' ' || upper(coalesce(part_type, 'nan'))), row_id) AS label FROM parts_catalog WHERE part_number IS NOT NULL GROUP BY 1),
 mp AS (SELECT 'kg:mapping/' || {_USLUG.format(e='lk.mention')} || '--' || {_USLUG.format(e='lk.part_number')} AS mapping_id, 'kg:part-mention/' || {_USLUG.format(e='lk.mention')} AS subject_id,
 'kg:partnr-' || lk.part_number AS object_id, fl.label AS object_label, round(confidence, 4) AS confidence, '2024-01-01' AS mapping_date, array_to_string(s.w[:-2], ' ') AS mapping_notes
 FROM lk JOIN fl USING (part_number) JOIN ({O._SPLIT}) s ON s.mention = lk.mention)"""
_trouble = lambda c: f"CASE WHEN {_node(c)} IS NOT NULL THEN {c} END"
_TROUBLE = O._triples(
    O.LOG, (_node("problem"), O._RDF + "type", O._k("Problem")), (_node("problem"), O._RDFS + "label", _trouble("problem")), (_node("problem"), _B + "hasCause", _node("location")),
    (_node("location"), O._RDF + "type", O._k("Cause")), (_node("location"), O._RDFS + "label", _trouble("location")),
    (_node("action"), O._RDF + "type", O._k("Remedy")), (_node("action"), O._RDFS + "label", _trouble("action")), (_node("action"), _B + "addresses", _node("problem")),
)
_CLASS_CHAIN = f"""WITH RECURSIVE kd AS (SELECT label AS a, list_extract(string_split(label, ' '), -1) AS b FROM canonical_items WHERE list_name = 'part_type'),
ln AS (SELECT DISTINCT {_node('a')} AS s, {_node('b')} AS o FROM (SELECT a, b FROM kd WHERE a <> b UNION SELECT b, 'HARDWARE' FROM kd WHERE a <> b) WHERE {_node('a')} IS NOT NULL AND {_node('b')} IS NOT NULL),
up AS (SELECT {_node('part_type')} AS c FROM parts_catalog WHERE {_node('part_type')} IS NOT NULL UNION SELECT ln.o FROM up JOIN ln ON ln.s = up.c)
"""
_OWN_PARTS = O._PARTS.rsplit(" UNION ", 1)[0]
_acy = O._DIGITS.format(l="cylinders")
_astate = f"CASE WHEN action <> '' THEN {_node("(action || ' action')")} END"
_apart = "nullif(regexp_replace(part, '^ +| +$', '', 'g'), '')"
_ACTIONS = with_("act", more=f"ax AS (SELECT ev, id, log_text, action, part, {_acy} AS cyl FROM act), ac AS (SELECT ev, 'Cylinder ' || unnest(regexp_extract_all(cyl, '\\d+')) AS l FROM ax)") + O._triples(
    "ax", ("ev", O._RDF + "type", O._k("Action")), ("ev", O._RDFS + "label", "'Action ' || id"), ("ev", O._DC + "description", "log_text"), ("ev", O._RDF + "type", _astate),
    (_astate, O._RDFS + "subClassOf", O._k("Action")), (_astate, O._RDFS + "label", "action"), ("ev", _B + "involves", _node(_apart)), (_node(_apart), O._RDFS + "label", f"CASE WHEN {_node(_apart)} IS NOT NULL THEN {_apart} END"),
    ("ev", _B + "location", "cyl"), ("ev", _B + "location", "'left'"), ("ev", _B + "atLocation", O._k("EngineLeft")), (O._k("EngineLeft"), O._RDFS + "label", "'Engine left'"), (O._k("EngineLeft"), O._RDF + "type", O._k("Location")),
    ("ev", _B + "dealsWith", f"'{_B}problem-' || id"),
) + " UNION " + O._triples("ac", ("ev", _B + "atLocation", _node("l")), (_node("l"), O._RDFS + "label", "l"), (_node("l"), O._RDF + "type", O._k("Location")))
_QUESTIONS = """q AS (SELECT feed || ' ' || strftime(loaded_at, '%Y-%m') AS question, lower(trim(component)) AS g, lower(trim(depends_on)) AS p FROM dependson WHERE loaded_at IS NOT NULL AND feed IS NOT NULL),
c AS (SELECT question, v, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p FROM (SELECT question, 'g' AS side, g AS v FROM q WHERE g IS NOT NULL UNION ALL SELECT question, 'p', p FROM q WHERE p IS NOT NULL) GROUP BY ALL),
t AS (SELECT question, sum(least(g, p))::BIGINT AS tp, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p FROM c GROUP BY 1)"""

_VALS = lambda c: f"list_transform(list_filter(list_transform(string_split({c}, CASE WHEN contains({c}, ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('none', 'nan')), lambda x: {{'v': x, 'label': '{c}'}})"
_SPANS = f"""WITH RECURSIVE r AS (SELECT row_id, ident, problem AS t, coalesce({_VALS('location')}, []) || coalesce({_VALS('part')}, []) || coalesce({_VALS('tggedproblem')}, []) AS vals FROM {O.LOG} WHERE trim(problem, ' ') <> ''),
s(k, row_id, ident, t, vals, spans) AS (SELECT 0, row_id, ident, t, vals, CAST([] AS STRUCT(a BIGINT, z BIGINT, label VARCHAR)[]) FROM r
 UNION ALL SELECT k + 1, row_id, ident, t, vals, CASE WHEN pos IS NULL THEN spans ELSE list_append(spans, {{'a': pos, 'z': pos + len(val.v), 'label': val.label}}) END
 FROM (SELECT *, list_filter(range(0, len(t)), lambda i: lower(t[i + 1:i + len(val.v)]) = lower(val.v) AND len(list_filter(spans, lambda x: NOT (i + len(val.v) <= x.a OR i >= x.z))) = 0)[1] AS pos FROM (SELECT *, vals[k + 1] AS val FROM s WHERE k < len(vals))))
SELECT ident, x.a::INT AS start, x.z::INT AS stop, x.label AS label FROM (SELECT ident, unnest(spans) AS x FROM s WHERE k = len(vals))"""

ORACLES = {
    "io_result_form": with_("hf", "lab") + "SELECT 'uri' AS kind, hf.o AS f, 'literal' AS l_kind, lab.o AS l, NULL AS none FROM hf JOIN lab ON lab.s = hf.o",
    "text_annotations": _SPANS,
    "cached_replies": """WITH c AS (SELECT n_name AS k, n_regionkey AS p, 'other' AS c, 1 AS n, n_name AS f FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'y' || r_name, r_regionkey, 'name', 1, r_name FROM region UNION ALL SELECT 'z' || r_name, r_regionkey, 'name', 2, r_name FROM region)
 SELECT n_name AS key, c.c AS "column", c.n, c.f AS first FROM nation JOIN c ON c.p = n_regionkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c.k = n_name DESC, c.c = 'name' DESC, c.n = n_nationkey % 3 DESC, c.k) = 1""",
    "io_csv": "SELECT row_id::VARCHAR AS row_id, nullif(section_name, '') AS section_name, nullif(figure, '') AS figure, figure_item::VARCHAR AS figure_item, nullif(part_number, '') AS part_number, nullif(part_type, '') AS part_type, nullif(specifics, '') AS specifics FROM parts_catalog",
    "io_csv_types": "SELECT row_id, figure_item + 1 AS next_item, nullif(part_number, '') AS part_number FROM parts_catalog",
    "io_tsv": "SELECT row_id::VARCHAR AS row_id, nullif(component, '') AS component, nullif(has_function, '') AS has_function FROM component_functions",
    "io_keep_empty": "SELECT row_id::VARCHAR AS row_id, coalesce(component, '') AS component, coalesce(has_function, '') AS has_function FROM component_functions",
    "io_ntriples": with_("hf") + _HF,
    "io_turtle": with_("hf") + _HF,
    "io_trig": with_("hf", "cd") + f"SELECT '{GRAPHS[0][1:-1]}' AS g, * FROM ({_HF}) UNION ALL SELECT '{GRAPHS[1][1:-1]}', * FROM ({_BOTH})",
    "io_one_graph": with_("hf") + _HF,
    "io_union_of_graphs": with_("hf", "cd") + _BOTH,
    "io_directory": _REGIONS,
    "io_directory_less_prefix": _REGIONS + " WHERE r_regionkey % 2 = 0",
    "io_canonical": " UNION ALL ".join(f"SELECT '{c}' AS predicate, count(*) AS n_lines, count(*) AS n_nodes FROM component_functions WHERE component IS NOT NULL AND has_function IS NOT NULL" for c in ("component", "has_function")),
    "io_catalog": "SELECT 'https://example.org/data/' || lower(r_name) || '.ttl' AS url, 'text/turtle' AS media_type FROM region",
    "io_sssom": f"WITH {_KEPT} SELECT * FROM mp",
    "io_sssom_rdf": f"""WITH {_KEPT}, n AS (SELECT count(DISTINCT mapping_id) AS m, count(DISTINCT subject_id || ' ' || object_id) AS pairs, count(DISTINCT mapping_id || ' ' || subject_id) AS src FROM mp)
 SELECT unnest(['relatedMatch', 'annotatedSource', 'type', 'wasGeneratedBy']) AS predicate, unnest([pairs, src, 2 * m, m]) AS n FROM n""",
    "link_simplified": f"WITH {_KEPT} SELECT mention, part_number, round(confidence, 4) AS confidence FROM lk QUALIFY row_number() OVER (PARTITION BY mention ORDER BY confidence DESC, reverse(part_number) DESC) = 1",
    "link_idf_stop": f"WITH {O._IDF} SELECT term, round(idf, 6) AS idf FROM idf WHERE term NOT IN ({', '.join(map(repr, STOP))})",
    "kg_trouble_lift": _TROUBLE,
    "kg_parts_lift_classes": _CLASS_CHAIN + _OWN_PARTS + f" UNION SELECT s, '{O._RDFS}subClassOf', o FROM ln WHERE s IN (SELECT c FROM up) UNION SELECT c, '{O._RDFS}subClassOf', '{_B}Part' FROM up WHERE c NOT IN (SELECT s FROM ln)",
    "kg_action_lift": _ACTIONS,
    "kg_literal_seeds": with_("num") + "SELECT DISTINCT s AS seed FROM num WHERE o = 'ZK-03516377-61'",
    "kg_retrieval_text": "SELECT unnest([1, 2])::INT AS depth, 'expand_subgraph(depth=' || unnest([1, 2]) || ', seeds=[" + ", ".join(sorted(s[1:-1] for s in O._SEEDS)) + "])' AS line",
    "kg_shapes": with_("ty", "hf", "cd", more=f"cn AS (SELECT s FROM ty WHERE o = '{_B}Component')") + f"""SELECT s AS node, '{_B}hasFunction' AS path, o AS value, 'class' AS rule FROM hf WHERE s IN (SELECT s FROM cn) AND o NOT IN (SELECT s FROM ty WHERE o = '{_B}Function')
 UNION ALL SELECT s, '{_B}componentDependsOn', o, 'class' FROM cd WHERE s IN (SELECT s FROM cn) AND o NOT IN (SELECT s FROM cn)
 UNION ALL SELECT s, '{_B}hasFunction', NULL, 'maxCount' FROM hf WHERE s IN (SELECT s FROM cn) GROUP BY s HAVING count(*) > 1""",
    "kg_count_by_three_keys": with_("ty", "inv", "lab") + "SELECT ty.o AS type, inv.o AS part, l.o AS l, count(*) AS n FROM ty JOIN inv ON inv.s = ty.s LEFT JOIN lab l ON l.s = inv.o GROUP BY 1, 2, 3",
    "json_records": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events UNION ALL SELECT event_id, 0 FROM events",
    "score_lenient": f"WITH {_QUESTIONS} SELECT 'strict' AS kind, question, tp, p - tp AS fp, g - tp AS fn FROM t UNION ALL SELECT 'loose', question, least(g, p), p - least(g, p), g - least(g, p) FROM t UNION ALL SELECT 'none', question, 0, p, g FROM t",
    "score_mean_of_none": "SELECT event_type, CASE WHEN event_type = 'click' THEN 'nan'::DOUBLE ELSE round(avg(value), 6) END AS mean, event_type = 'click' AS none, event_type = 'click' AS no_std FROM events GROUP BY 1",
    "context_hash": O._AROUND + " SELECT sha256(string_agg('<' || s || '> <' || p || '> <' || o || '> .', chr(10) ORDER BY '<' || s || '> <' || p || '> <' || o || '> .') || chr(10)) AS hash FROM g",
    "price_cost": """SELECT lang AS model, count(*) AS calls, round(sum(CASE lang WHEN 'en' THEN 0.000002 * greatest(1, length(text) // 4) + 0.0001 WHEN 'de' THEN 0.000003 * greatest(1, length(text) // 4) END)::DOUBLE, 6) AS cost
 FROM documents WHERE text IS NOT NULL AND lang IN ('en', 'de', 'fr') GROUP BY 1""",
    "report_status": " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'empty' END AS status, count(*) AS n FROM ({K.ORACLES[n]})" for n in _REPORTED) + " UNION ALL SELECT 'broken', 'error', 0",
    "report_chart": f"SELECT trim(regexp_replace(regexp_replace(regexp_replace(part, '^.*[#/]', ''), '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS label, n::DOUBLE AS value FROM ({K.ORACLES['kg_topk_parts']}) ORDER BY n DESC, part LIMIT 5",
}
