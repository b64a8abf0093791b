"""Queries on extraction, linking, retrieval, scoring and lifts over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import BASE, slug, text
from .kg import Maintenance
from .kg_queries import SPARQL, _node, _slug, with_
from .operators import extraction as X
from .operators import linking as L
from .operators import retrieval as R
from .operators import scoring as S
from .operators.closure import superclasses
from .plans import lift
from .session import table
from .sources.tables import first_seen

LOG, EXT = "aircraft_annotation_datafile", "problem_extractions_regex"


def text_clean_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LOG).select("row_id", X.clean_log(F.col("problem")).alias("problem"), X.clean_log(F.col("action"), compat_nan=True).alias("action"))


def text_problem_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LOG).select("row_id", *X.problem_groups(X.clean_log(F.col("problem")))).filter("problem is not null")


def text_action_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LOG).select("row_id", *X.action_groups(X.clean_log(F.col("action")))).filter("action is not null")


def text_location_clean(spark: SparkSession, d: str) -> DataFrame:
    loc = X.clean_location(F.col("location"))
    return table(spark, d, LOG).select("row_id", loc.alias("place"), X.cylinder_digits(loc).alias("cylinders"), X.engine_place(loc).alias("engine"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_items").filter("list_name = 'part_type'").select(F.element_at(F.split("label", " "), -1).alias("Part")).distinct()


def text_head_whitelist(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, EXT).select(F.upper("part").alias("part"))
    return X.head_whitelist(parts, _classes(spark, d), tail=20)


def text_extract_problems(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_problems(table(spark, d, LOG), _classes(spark, d), tail=20)


def text_extract_actions(spark: SparkSession, d: str) -> DataFrame:
    return X.extract_actions(table(spark, d, LOG), _classes(spark, d), tail=20)


def text_chunking(spark: SparkSession, d: str) -> DataFrame:
    b = X.batches(table(spark, d, LOG).select("row_id", "ident"), "row_id", 20)
    return b.select("batch", F.size("rows").cast("bigint").alias("n"), F.get("rows", F.lit(0))["row_id"].alias("first_id"), F.element_at("rows", -1)["row_id"].alias("last_id"))


def text_label_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LOG).select("row_id", F.posexplode(X.label_values(F.col("tggedproblem"))).alias("pos", "value"))


def text_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subfunction").select("row_id", slug("function_name").alias("slug"))


def link_lemma_head(spark: SparkSession, d: str) -> DataFrame:
    head, mods = L.split_head(F.lower("mention"))
    return L.mentions(table(spark, d, EXT)).select("mention", head.alias("head"), mods.alias("modifiers"))


def link_synonyms(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.lower(F.trim(F.regexp_replace("mention", r"\s+", " "))), " ")
    return L.mentions(table(spark, d, EXT)).select("mention", F.array_join(L.expand(words), " ").alias("query"))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return L.normalise_catalog(table(spark, d, "parts_catalog").filter("part_number is not null"), "section_name", "figure", "part_number", "part_type", "specifics", "row_id")


def link_idf(spark: SparkSession, d: str) -> DataFrame:
    return L.idf(_catalog(spark, d), []).select("term", F.round("idf", 6).alias("idf"))


def link_tfidf(spark: SparkSession, d: str) -> DataFrame:
    s = L.score(L.mentions(table(spark, d, EXT)), _catalog(spark, d))
    return s.select("mention", F.col("order").alias("catalog_row"), F.round("score", 6).alias("score"))


def link_dropoff(spark: SparkSession, d: str) -> DataFrame:
    out = L.link(L.mentions(table(spark, d, EXT)), _catalog(spark, d))
    return out.select("mention", "part_number", F.round("confidence", 4).alias("confidence"))


def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(table(spark, d, EXT), "part", "row_id")


def kg_event_lift(spark: SparkSession, d: str) -> DataFrame:
    logs = lift.log_index(table(spark, d, LOG).filter("ident is not null").select("ident", "problem", "action", "row_id"))
    t = lift.lift_events(table(spark, d, EXT).select("id", "part", "problem", "cylinders", "engine"), logs, "problem")
    return t.select(text("s").alias("s"), text("p").alias("p"), text("o").alias("o"))


def kg_functions_lift(spark: SparkSession, d: str) -> DataFrame:
    t = lift.lift_functions(table(spark, d, "component_functions"), table(spark, d, "subfunction"), table(spark, d, "dependson"))
    return t.select(text("s").alias("s"), text("p").alias("p"), text("o").alias("o"))


def kg_parts_lift(spark: SparkSession, d: str) -> DataFrame:
    t = lift.lift_catalog(table(spark, d, "parts_catalog"), None, "section_name", "figure", "part_number", "part_type", "specifics")
    return t.select(text("s").alias("s"), text("p").alias("p"), text("o").alias("o"))


def kg_function_cross_product(spark: SparkSession, d: str) -> DataFrame:
    m = Maintenance(spark, d)
    dep = m.component_dependencies().select(F.col("s").alias("a"), F.col("o").alias("b"))
    t = lift.function_dependencies(m.has_function().select(F.col("s").alias("c"), F.col("o").alias("f")).distinct(), dep)
    return t.select(text("s").alias("s"), text("o").alias("o"))


def kg_superclass_chain(spark: SparkSession, d: str) -> DataFrame:
    c = superclasses(Maintenance(spark, d).sub_function_of())
    return c.select(text("s").alias("s"), text("o").alias("o"), F.col("depth").cast("bigint").alias("depth"))


_SEEDS = [f"<{BASE}ExhaustTrunk>", f"<{BASE}FuelFeedTrunk>"]


def _around(spark: SparkSession, d: str) -> DataFrame:
    m = Maintenance(spark, d)
    n = lambda x: F.lit(f"<{BASE}{x}>").alias("p")
    t = m.has_function().select("s", n("hasFunction"), "o").unionByName(m.component_dependencies().select("s", n("dependsOn"), "o")).unionByName(m.sub_function_of().select("s", n("subFunctionOf"), "o"))
    return R.khop(t, spark.createDataFrame([(s,) for s in _SEEDS], "n string"), 1)


def kg_khop_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d).select(text("s").alias("s"), text("p").alias("p"), text("o").alias("o"))


def kg_subgraph_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return R.predicate_breakdown(_around(spark, d), 2)


def kg_term_types(spark: SparkSession, d: str) -> DataFrame:
    return R.term_types(_around(spark, d))


def kg_seed_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame(sorted(SPARQL.items()), "question string, query string")
    return R.seed_tokens(q, "question", "query").select("question", F.regexp_replace("seed", "[<>]", "").alias("seed"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    dep = table(spark, d, "dependson")
    side = lambda c, s: dep.select(F.col("feed").alias("question"), F.lit(s).alias("side"), F.array(F.lower(F.trim(c))).alias("cells")).filter(F.col("cells")[0].isNotNull())
    return side("component", "gold").unionByName(side("depends_on", "pred"))


def score_exact_prf(spark: SparkSession, d: str) -> DataFrame:
    s = S.score_exact(_answers(spark, d), ["question"])
    return s.select("question", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def score_macro_micro(spark: SparkSession, d: str) -> DataFrame:
    m = S.macro_micro(S.score_exact(_answers(spark, d), ["question"]))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


def score_mean_std(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_std(table(spark, d, "events"), "value", ["event_type"])
    return m.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def norm_unique_labels(spark: SparkSession, d: str) -> DataFrame:
    m = Maintenance(spark, d)
    lab = m.label().withColumn("p", F.lit(lift.LABEL)).distinct()
    return S.unique_labels(lab)


def norm_canonical(spark: SparkSession, d: str) -> DataFrame:
    m = Maintenance(spark, d)
    lab = m.label().withColumn("p", F.lit(lift.LABEL)).distinct()
    fun = table(spark, d, "component_functions")
    values = fun.select("row_id", F.col("has_function").alias("value")).unionByName(fun.select("row_id", F.concat(F.lit("kg:"), F.col("component")).alias("value"))).filter("value is not null")
    return S.canonical(values, "value", S.unique_labels(lab), S.unique_local_names(lab), {"kg": BASE}).select("row_id", "value", "canonical")


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "struct<k: int>")["k"].cast("bigint").alias("k"))


def cost_sum(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").filter("text is not null")
    cost = S.request_cost(S.estimate_tokens(F.col("text")), F.lit("0.000002"), F.lit("0.0001"))
    out = doc.select("source", S.estimate_tokens(F.col("text")).alias("tokens"), cost.alias("cost")).groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return out.select("source", "calls", "tokens", F.round(F.col("cost").cast("double"), 6).alias("cost"))


def sha_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, LOG).select("row_id", S.cache_key(F.col("action"), F.col("ident"), F.col("problem")).alias("key"))


_NAMES = (
    "text_clean_logs text_problem_groups text_action_groups text_location_clean text_head_whitelist text_extract_problems text_extract_actions text_chunking text_label_values text_slug "
    "link_lemma_head link_synonyms link_idf link_tfidf link_dropoff first_mentions kg_event_lift kg_functions_lift kg_parts_lift kg_function_cross_product kg_superclass_chain kg_khop_subgraph "
    "kg_subgraph_telemetry kg_term_types kg_seed_tokens score_exact_prf score_macro_micro score_mean_std norm_unique_labels norm_canonical json_extract cost_sum sha_key"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ---- SQL -------------------------------------------------------------------------------------------------

_WS = r"[\s\x{00A0}]"


def _clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\.+|\.+$', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _groups(src: str, pattern: str, names: list[str]) -> str:
    rx = _q("(?i)" + pattern)
    cols = ", ".join(f"regexp_extract(t, '{rx}', {i}) AS \"{n}\"" for i, n in enumerate(names, 1))
    return f"SELECT row_id, ident, {cols}, regexp_matches(t, '{rx}') AS hit FROM (SELECT row_id, ident, {_clean(src)} AS t FROM {LOG})"


_PG = _groups("problem", X.PROBLEM, ["loc1", "part", "loc2", "problem", "loc3", "rest"])
_AG = _groups("action", X.ACTION, ["action", "location", "part"])


def _loc(e: str) -> str:
    for w in X.PLACE_WORDS:
        e = f"replace({e}, '{w}', '')"
    return f"nullif(trim(regexp_replace(replace({e}, 'ALL', '1 2 3 4'), '\\s+', ' ', 'g')), '')"


_DIGITS = "nullif(array_to_string(list_sort(list_distinct(regexp_extract_all({l}, '\\d'))), ' '), '')"
_ENGINE = "nullif(trim(regexp_replace({l}, '\\d', '', 'g')), '')"
_SQ = "trim(regexp_replace({c}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_HEAD = f"nullif(list_extract(string_split({_SQ}, ' '), -1), '')"
_CLASSES = "SELECT DISTINCT list_extract(string_split(label, ' '), -1) AS head FROM canonical_items WHERE list_name = 'part_type'"


def _white(parts: str) -> str:
    return f"classes AS ({_CLASSES}), heads AS (SELECT {_HEAD.format(c='part')} AS head FROM ({parts})), tail AS (SELECT head FROM (SELECT head, count(*) AS n FROM heads WHERE head IS NOT NULL AND head NOT IN (SELECT head FROM classes) GROUP BY 1 ORDER BY n DESC, head LIMIT 20)), white AS (SELECT head FROM classes UNION ALL SELECT head FROM tail)"


_JOINED = "array_to_string(list_filter([loc1, loc2, loc3], lambda v: trim(v) <> ''), ' ')"
_M = "SELECT DISTINCT trim(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) AS mention FROM problem_extractions_regex WHERE trim(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) <> ''"


def _lemma(e: str) -> str:
    e = f"lower({e})"
    return f"CASE WHEN ends_with({e}, 'ies') THEN {e}[:-4] || 'y' WHEN ends_with({e}, 'es') AND NOT ends_with({e}, 'ses') THEN {e}[:-3] WHEN ends_with({e}, 's') AND NOT ends_with({e}, 'ss') THEN {e}[:-2] ELSE {e} END"


_SPLIT = f"SELECT mention, string_split({_SQ.format(c='lower(mention)')}, ' ') AS w FROM ({_M})"
_SYN = "w || " + " || ".join(f"CASE WHEN list_contains(w, '{k}') THEN {v} ELSE [] END" for k, v in L.SYNONYMS.items())
_QUERY = f"array_to_string(list_sort(list_distinct({_SYN})), ' ')"
_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_DESC = "concat_ws(' ', coalesce(section_name, ''), coalesce(figure, ''), lower(coalesce(part_type, 'nan')), coalesce(specifics, ''))"
_IDF = f"""cat AS (SELECT row_id, part_number, {_lemma("coalesce(part_type, 'nan')")} AS head, {_DESC} AS d FROM parts_catalog WHERE part_number IS NOT NULL),
ct AS (SELECT row_id, part_number, head, unnest({_TOK.format(c='d')}) AS term FROM cat),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM cat)) / (1 + count(DISTINCT row_id))) + 1 AS idf FROM ct GROUP BY 1)"""
_SCORE = f"""{_IDF}, cw AS (SELECT row_id, part_number, head, term, count(*) * any_value(idf) AS w FROM ct JOIN idf USING (term) GROUP BY ALL),
cn AS (SELECT row_id, sqrt(sum(w * w)) AS n FROM cw GROUP BY 1), m AS ({_SPLIT}), mq AS (SELECT mention, {_lemma('list_extract(w, -1)')} AS head, unnest({_TOK.format(c=_QUERY)}) AS term FROM m),
qw AS (SELECT mention, head, term, count(*) * any_value(idf) AS w FROM mq JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT mention, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
sc AS (SELECT qw.mention, cw.row_id, cw.part_number, sum(qw.w / qn.n * cw.w / cn.n) AS score FROM qw JOIN qn USING (mention) JOIN cw ON cw.head = qw.head AND cw.term = qw.term JOIN cn ON cn.row_id = cw.row_id GROUP BY ALL)"""

_B = BASE
_RDFS, _RDF, _DC = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://purl.org/dc/elements/1.1/"


def _triples(src: str, *rows: tuple[str, str, str]) -> str:
    """SQL of the triples (s, p, o) that each row of a source gives; p is a plain IRI."""
    return " UNION ".join(f"SELECT s, '{p}' AS p, o FROM (SELECT {s} AS s, {o} AS o FROM {src}) WHERE s IS NOT NULL AND o IS NOT NULL" for s, p, o in rows)


_k = lambda x: f"'{_B}{x}'"
_state = f"CASE WHEN problem <> '' THEN {_node("(problem || ' problem')")} END"
_part = "nullif(trim(part), '')"
_eng = "nullif(trim(engine), '')"
_EVENTS = f"""WITH idx AS (SELECT ident, problem AS log_text FROM {LOG} WHERE ident IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ident ORDER BY row_id DESC) = 1),
e AS (SELECT '{_B}problem-' || id AS ev, x.*, log_text FROM {EXT} x JOIN idx ON idx.ident = x.id), c AS (SELECT ev, 'Cylinder ' || unnest(regexp_extract_all(cylinders, '\\d+')) AS l FROM e)
""" + _triples("e", ("ev", _RDF + "type", _k("Problem")), ("ev", _RDFS + "label", "'Problem ' || id"), ("ev", _DC + "description", "log_text"), ("ev", _RDF + "type", _state),
    (_state, _RDFS + "subClassOf", _k("Problem")), (_state, _RDFS + "label", "problem"), ("ev", _B + "involves", _node(_part)), (_node(_part), _RDFS + "label", _part),
    ("ev", _B + "location", "nullif(cylinders, '')"), ("ev", _B + "location", _eng), ("ev", _B + "atLocation", _node(f"('Engine ' || {_eng})")),
    (_node(f"('Engine ' || {_eng})"), _RDFS + "label", f"'Engine ' || {_eng}"), (_node(f"('Engine ' || {_eng})"), _RDF + "type", _k("Location"))) + " UNION " + _triples("c", ("ev", _B + "atLocation", _node("l")), (_node("l"), _RDFS + "label", "l"), (_node("l"), _RDF + "type", _k("Location")))

_fun = lambda c: ((_node(c), _RDF + "type", _k("Function")), (_node(c), _RDFS + "label", f"CASE WHEN {_node(c)} IS NOT NULL THEN {c} END"))
_FUNCTIONS = with_("cd", "hf", "fd") + " UNION ".join([
    _triples("component_functions", *_fun("has_function")), _triples("subfunction", *_fun("sub_function_of"), *_fun("function_name"), (_node("function_name"), _B + "subFunctionOf", _node("sub_function_of"))),
    _triples("hf", ("s", _B + "hasFunction", "o")), _triples("cd", ("s", _B + "dependsOn", "o")), _triples("fd", ("s", _B + "dependsOn", "o")),
])
_pn = f"CASE WHEN trim(part_number) <> '' THEN '{_B}partnr-' || part_number END"
_PARTS = _triples("parts_catalog", (_node("section_name"), _RDF + "type", _k("System")), (_node("section_name"), _RDFS + "label", "section_name"), (_node("figure"), _RDF + "type", _k("Assembly")), (_node("figure"), _RDFS + "label", "figure"),
    (_node("figure"), _B + "partOf", _node("section_name")), (_pn, _RDF + "type", _k("PartInstance")), (_pn, _RDFS + "label", "coalesce(CASE WHEN trim(specifics) <> '' THEN specifics END, part_type)"),
    (_pn, _B + "partNumber", "part_number"), (_pn, _B + "partOf", _node("figure")), (_pn, _B + "partOf", _node("section_name")), (_pn, _RDFS + "subClassOf", _node("part_type")), (_node("part_type"), _RDFS + "subClassOf", _k("Part")))
_AROUND = with_("cd", "hf", "sf") + f""", t AS (SELECT s, '{_B}hasFunction' AS p, o FROM hf UNION SELECT s, '{_B}dependsOn', o FROM cd UNION SELECT s, '{_B}subFunctionOf', o FROM sf),
n0 AS (SELECT unnest(['{_SEEDS[0][1:-1]}', '{_SEEDS[1][1:-1]}']) AS n), n1 AS (SELECT n FROM n0 UNION SELECT o FROM t WHERE s IN (SELECT n FROM n0) UNION SELECT s FROM t WHERE o IN (SELECT n FROM n0)),
g AS (SELECT DISTINCT s, p, o FROM t WHERE s IN (SELECT n FROM n1) OR o IN (SELECT n FROM n1))"""
_ANS = "a AS (SELECT feed AS question, 'gold' AS side, lower(trim(component)) AS c FROM dependson UNION ALL SELECT feed, 'pred', lower(trim(depends_on)) FROM dependson)"
_PRF = f"""WITH {_ANS}, n AS (SELECT question, c, count(*) FILTER (side = 'gold') AS g, count(*) FILTER (side = 'pred') AS p FROM a WHERE c IS NOT NULL GROUP BY ALL),
s AS (SELECT question, sum(least(g, p))::BIGINT AS tp, (sum(p) - sum(least(g, p)))::BIGINT AS fp, (sum(g) - sum(least(g, p)))::BIGINT AS fn FROM n GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM s),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""
_MK = "nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"
_LABELS = with_("lab") + f", ul AS (SELECT {_MK.format(c='o')} AS key, min(s) AS iri FROM lab WHERE {_MK.format(c='o')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) = 1)"

ORACLES = {
    "text_clean_logs": f"SELECT row_id, {_clean('problem')} AS problem, coalesce({_clean('action')}, 'nan') AS action FROM {LOG}",
    "text_problem_groups": f"SELECT * EXCLUDE (hit, ident) FROM ({_PG}) WHERE hit",
    "text_action_groups": f"SELECT * EXCLUDE (hit, ident) FROM ({_AG}) WHERE hit",
    "text_location_clean": f"SELECT row_id, l AS place, {_DIGITS.format(l='l')} AS cylinders, {_ENGINE.format(l='l')} AS engine FROM (SELECT row_id, {_loc('location')} AS l FROM {LOG})",
    "text_head_whitelist": f"WITH {_white(f'SELECT upper(part) AS part FROM {EXT}')} SELECT head FROM white",
    "text_extract_problems": f"""WITH g AS ({_PG}), x AS (SELECT ident AS id, CASE WHEN hit THEN upper(part) END AS part, CASE WHEN hit THEN problem END AS problem, CASE WHEN hit THEN rest END AS rest, CASE WHEN hit THEN {_loc(_JOINED)} END AS l FROM g),
 {_white('SELECT part FROM x')} SELECT coalesce(id, '') AS id, CASE WHEN {_HEAD.format(c='part')} IN (SELECT head FROM white) THEN part ELSE '' END AS part, coalesce(problem, '') AS problem, coalesce(rest, '') AS rest, coalesce({_DIGITS.format(l='l')}, '') AS cylinders, coalesce({_ENGINE.format(l='l')}, '') AS engine FROM x""",
    "text_extract_actions": f"""WITH g AS ({_AG}), x AS (SELECT ident AS id, CASE WHEN hit THEN upper(part) END AS part, CASE WHEN hit THEN action END AS action, CASE WHEN hit THEN {_loc('location')} END AS l FROM g),
 {_white('SELECT part FROM x')} SELECT coalesce(id, '') AS id, coalesce(action, '') AS action, CASE WHEN {_HEAD.format(c='part')} IN (SELECT head FROM white) THEN part ELSE '' END AS part, coalesce({_DIGITS.format(l='l')}, '') AS cylinders, coalesce({_ENGINE.format(l='l')}, '') AS engine FROM x""",
    "text_chunking": f"SELECT (n // 20)::BIGINT AS batch, count(*) AS n, min(row_id) AS first_id, max(row_id) AS last_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS n FROM {LOG}) GROUP BY 1",
    "text_label_values": f"SELECT row_id, (i - 1)::INT AS pos, v[i] AS value FROM (SELECT row_id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT row_id, list_filter(list_transform(string_split(tggedproblem, CASE WHEN contains(tggedproblem, ';') THEN ';' ELSE ',' END), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('none', 'nan')) AS v FROM {LOG}))",
    "text_slug": f"SELECT row_id, {_slug('function_name')} AS slug FROM subfunction",
    "link_lemma_head": f"SELECT mention, {_lemma('list_extract(w, -1)')} AS head, array_to_string(w[:-2], ' ') AS modifiers FROM ({_SPLIT})",
    "link_synonyms": f"SELECT mention, {_QUERY} AS query FROM ({_SPLIT})",
    "link_idf": f"WITH {_IDF} SELECT term, round(idf, 6) AS idf FROM idf",
    "link_tfidf": f"WITH {_SCORE} SELECT mention, row_id AS catalog_row, round(score, 6) AS score FROM sc WHERE score > 0",
    "link_dropoff": f"""WITH {_SCORE}, o AS (SELECT *, coalesce((score - lead(score) OVER w) / score, 0) > 0.5 AS dropped FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY mention ORDER BY round(score, 12) DESC, row_id)),
 k AS (SELECT *, coalesce(sum(dropped::INT) OVER (PARTITION BY mention ORDER BY round(score, 12) DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM o),
 h AS (SELECT *, score / sum(score) OVER (PARTITION BY mention) AS share FROM k WHERE b = 0) SELECT mention, part_number, round(round(min(share), 5), 4) AS confidence FROM h GROUP BY ALL""",
    "first_mentions": f"SELECT trim(part) AS part, min(row_id) AS row_id FROM {EXT} WHERE trim(part) <> '' GROUP BY 1",
    "kg_event_lift": _EVENTS,
    "kg_functions_lift": _FUNCTIONS,
    "kg_parts_lift": _PARTS,
    "kg_function_cross_product": with_("cd", "hf", "fd") + "SELECT s, o FROM fd",
    "kg_superclass_chain": with_("sf", more="r(s, o, d) AS (SELECT s, o, 1 FROM sf UNION SELECT r.s, t.o, d + 1 FROM r JOIN sf t ON t.s = r.o WHERE d <= (SELECT count(*) FROM (SELECT s FROM sf UNION SELECT o FROM sf)))") + "SELECT s, o, min(d)::BIGINT AS depth FROM r GROUP BY 1, 2",
    "kg_khop_subgraph": _AROUND + " SELECT * FROM g",
    "kg_subgraph_telemetry": _AROUND + " SELECT CASE WHEN r <= 2 THEN p ELSE '__other__' END AS predicate, sum(c)::BIGINT AS count FROM (SELECT p, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, p) AS r FROM g GROUP BY p) GROUP BY 1",
    "kg_term_types": _AROUND + " SELECT 'subject' AS position, 'uri' AS term_type, count(*) AS count FROM g UNION ALL SELECT 'object', 'uri', count(*) FROM g",
    "kg_seed_tokens": "SELECT DISTINCT question, '" + _B + "' || unnest(regexp_extract_all(q, ':([A-Za-z0-9_]+)', 1)) AS seed FROM (VALUES " + ", ".join(f"('{k}', '{_q(v)}')" for k, v in sorted(SPARQL.items())) + ") v(question, q)",
    "score_exact_prf": f"{_PRF} SELECT question, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r",
    "score_macro_micro": f"""{_PRF}, u AS (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(tp) / sum(tp + fp) AS micro_precision, sum(tp) / sum(tp + fn) AS micro_recall FROM r)
 SELECT round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, round(micro_precision, 6) AS micro_precision, round(micro_recall, 6) AS micro_recall, round(2 * micro_precision * micro_recall / (micro_precision + micro_recall), 6) AS micro_f1 FROM u""",
    "score_mean_std": "SELECT event_type, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS std FROM events GROUP BY 1",
    "norm_unique_labels": _LABELS + " SELECT key, iri FROM ul",
    "norm_canonical": _LABELS + f""", ll AS (SELECT lower(regexp_replace(s, '.+#', '')) AS key, min(s) AS iri FROM lab GROUP BY 1 HAVING count(DISTINCT s) = 1),
 v AS (SELECT row_id, has_function AS value, CAST(NULL AS VARCHAR) AS fixed, {_MK.format(c='has_function')} AS key FROM component_functions UNION ALL SELECT row_id, 'kg:' || component, '{_B}' || rtrim(component, ' ' || chr(9)), NULL FROM component_functions)
 SELECT row_id, value, coalesce(fixed, ul.iri, ll.iri, v.key, '') AS canonical FROM v LEFT JOIN ul ON ul.key = v.key LEFT JOIN ll ON ll.key = v.key WHERE value IS NOT NULL""",
    "json_extract": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
    "cost_sum": "SELECT source, count(*) AS calls, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, round(sum(0.000002 * greatest(1, length(text) // 4) + 0.0001)::DOUBLE, 6) AS cost FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "sha_key": f"SELECT row_id, sha256('{{' || array_to_string(list_filter(['\"action\":' || to_json(action), '\"ident\":' || to_json(ident), '\"problem\":' || to_json(problem)], lambda x: x IS NOT NULL), ',') || '}}') AS key FROM {LOG}",
}
