"""Graph queries over the maintenance tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.terms import BASE
from .kg import Maintenance
from .operators.extraction import ACTION, PLACE_WORDS
from .plans.planner import run

PREFIXES = f"PREFIX : <{BASE}> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX dc: <http://purl.org/dc/elements/1.1/>\n"

SPARQL = {
    "kg_bind_const": 'SELECT ?c ?dep WHERE { BIND(:MainCrankAssembly AS ?c) ?c :componentDependsOn ?dep }',
    "kg_bgp_const": "SELECT ?c WHERE { ?c :hasFunction :IsolatingValveLift }",
    "kg_object_join": "SELECT ?f ?other WHERE { BIND(:ExhaustTrunk AS ?c) ?c :hasFunction ?f . ?other :hasFunction ?f }",
    "kg_values_join": "SELECT ?c ?f WHERE { VALUES ?c { :MainCrankAssembly :ExhaustTrunk } ?c :hasFunction ?f }",
    "kg_bgp_star": 'SELECT DISTINCT ?whole WHERE { ?p :partNumber "ZK-03516377-61" ; :partOf ?whole }',
    "kg_filter_star": 'SELECT ?p ?whole WHERE { ?p :partNumber ?n ; :partOf ?whole . ?whole a :System FILTER(STRSTARTS(?n, "TR") && STRLEN(?n) > 12) }',
    "kg_type_semi": "SELECT ?asm ?sys WHERE { ?asm :partOf ?sys . ?asm a :Assembly . ?sys a :System }",
    "kg_bgp_path": "SELECT ?problem ?state WHERE { ?problem rdf:type ?state . ?state rdfs:subClassOf :Problem . ?problem :atLocation :Cylinder2 }",
    "kg_group_concat_distinct": 'SELECT ?f (GROUP_CONCAT(DISTINCT ?c; separator=", ") AS ?list) (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c :hasFunction ?f } GROUP BY ?f HAVING (COUNT(DISTINCT ?c) > 1) ORDER BY DESC(?n)',
    "kg_union_tagged": 'SELECT ?rel ?d WHERE { BIND(:SustainingPoweredFlight AS ?f) { BIND("below" AS ?rel) ?d :subFunctionOf+ ?f } UNION { BIND("above" AS ?rel) ?f :subFunctionOf+ ?d } } ORDER BY ?rel ?d',
    "kg_path_plus_backward": "SELECT DISTINCT ?g WHERE { ?g :subFunctionOf+ :SustainingPoweredFlight . ?g a :Function }",
    "kg_path_plus_forward": "SELECT ?x WHERE { :MainCrankAssembly :componentDependsOn+ ?x }",
    "kg_path_cycle_self": "SELECT ?f WHERE { ?f :subFunctionOf+ ?f }",
    "kg_path_seq_alt": "SELECT DISTINCT ?c ?x WHERE { VALUES ?c { :ExhaustTrunk } ?c :componentDependsOn/(:hasFunction|:componentDependsOn) ?x }",
    "kg_minus": "SELECT DISTINCT ?f WHERE { ?f a :Function MINUS { ?f :subFunctionOf ?p } }",
    "kg_not_exists": "SELECT DISTINCT ?c WHERE { ?c :componentDependsOn ?d FILTER NOT EXISTS { ?c :hasFunction ?f } }",
    "kg_critical": "SELECT ?f (COUNT(DISTINCT ?g) AS ?n) WHERE { ?c :hasFunction ?f . ?f a :Function . ?g :dependsOn ?f . ?g a :Function } GROUP BY ?f ORDER BY DESC(?n)",
    "kg_optional_label": 'SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c :hasFunction ?f OPTIONAL { ?f rdfs:label ?l } BIND(COALESCE(?l, REPLACE(STR(?f), ".+#", "")) AS ?name) } GROUP BY ?name ORDER BY DESC(?n)',
    "kg_topk_types": "SELECT ?state (COUNT(?problem) AS ?n) WHERE { ?problem rdf:type ?state . ?state rdfs:subClassOf :Problem } GROUP BY ?state ORDER BY DESC(?n) LIMIT 10",
    "kg_count_global": "SELECT (COUNT(?problem) AS ?n) WHERE { ?problem rdf:type :CrackedProblem }",
    "kg_topk_parts": "SELECT ?part (COUNT(?problem) AS ?n) WHERE { ?problem :involves ?part } GROUP BY ?part ORDER BY DESC(?n) LIMIT 10",
    "kg_select_distinct": "SELECT DISTINCT ?part WHERE { ?problem rdf:type :LeakingProblem ; :involves ?part }",
    "kg_values_actions": "SELECT DISTINCT ?type WHERE { VALUES ?part { :IntakeGasket :WastegateClamp } ?problem rdf:type :CrackedProblem ; :involves ?part . ?action rdf:type ?type ; :dealsWith ?problem }",
    "kg_values_types": "SELECT DISTINCT ?part ?type WHERE { VALUES ?part { :IntakeGasket :WastegateClamp } ?problem :involves ?part ; rdf:type ?type }",
    "kg_count_by_two_keys": "SELECT ?type ?location (COUNT(?problem) AS ?n) WHERE { ?problem rdf:type ?type ; :atLocation ?location OPTIONAL { ?location rdfs:label ?l } } GROUP BY ?type ?location ORDER BY DESC(?n)",
    "kg_topk_descriptions": "SELECT ?d (COUNT(?problem) AS ?n) WHERE { ?problem dc:description ?d ; rdf:type :Problem } GROUP BY ?d ORDER BY DESC(?n) LIMIT 10",
    "kg_both_locations": "SELECT ?problem WHERE { ?problem rdf:type :Problem ; :atLocation :Cylinder2 ; :atLocation :Cylinder4 }",
    "kg_actions_leaking": "SELECT ?action ?d WHERE { ?problem rdf:type :LeakingProblem ; :atLocation :Cylinder4 . ?action :dealsWith ?problem ; dc:description ?d }",
    "kg_topk_part_types": 'SELECT ?name (COUNT(?problem) AS ?n) WHERE { ?problem :involves ?part . ?part rdf:type ?t OPTIONAL { ?t rdfs:label ?l } BIND(COALESCE(?l, REPLACE(STR(?t), ".+#", "")) AS ?name) } GROUP BY ?name ORDER BY DESC(?n) LIMIT 10',
    "kg_topk_action_types": 'SELECT ?name (COUNT(?action) AS ?n) WHERE { ?action :dealsWith ?problem ; rdf:type ?t OPTIONAL { ?t rdfs:label ?l } BIND(COALESCE(?l, REPLACE(STR(?t), ".+#", "")) AS ?name) } GROUP BY ?name ORDER BY DESC(?n) LIMIT 10',
    "kg_subselect": "SELECT ?c ?n WHERE { ?c a :Component { SELECT ?c (COUNT(?d) AS ?n) WHERE { ?c :componentDependsOn ?d } GROUP BY ?c } }",
}


def _query(text: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return run(Maintenance(spark, d).store(), PREFIXES + text)

    return q


QUERIES = {k: _query(v) for k, v in SPARQL.items()}

# ---- SQL: each predicate as a table of distinct (s, o) -----------------------------------------------------


def _slug(e: str) -> str:
    clean = f"regexp_replace({e}, '[^\\w\\s\\x{{00A0}}-]', '', 'g')"
    return f"regexp_replace(array_to_string(list_transform(regexp_extract_all({clean}, '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda r: upper(r[1:1]) || lower(r[2:])), ''), '[\\s\\x{{00A0}}]+', '', 'g')"


def _node(e: str) -> str:
    return f"('{BASE}' || nullif({_slug(e)}, ''))"


def _location(e: str) -> str:
    for w in PLACE_WORDS:
        e = f"replace({e}, '{w}', '')"
    return f"trim(regexp_replace(replace({e}, 'ALL', '1 2 3 4'), '\\s+', ' ', 'g'))"


_state = lambda k: f"CASE WHEN trim({k}) <> '' THEN {_node(f"({k} || ' {k}')")} END"

CTES = {
    "idx": "SELECT * FROM aircraft_annotation_datafile WHERE ident IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ident ORDER BY row_id DESC) = 1",
    "prob": f"SELECT '{BASE}problem-' || id AS ev, * FROM problem_extractions_regex WHERE id IN (SELECT ident FROM idx)",
    "cleaned": r"SELECT ident, action AS log_text, regexp_replace(regexp_replace(regexp_replace(action, '^\.+', ''), '\.+$', ''), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS t FROM idx",
    "act": f"""SELECT '{BASE}action-' || ident AS ev, ident AS id, log_text, regexp_extract(t, '(?i){ACTION}', 1) AS action,
 upper(regexp_extract(t, '(?i){ACTION}', 3)) AS part, {_location(f"regexp_extract(t, '(?i){ACTION}', 2)")} AS cylinders FROM cleaned WHERE regexp_matches(t, '(?i){ACTION}')""",
    "kind": "SELECT label, list_extract(string_split(label, ' '), -1) AS k FROM canonical_items WHERE list_name = 'part'",
    "ty": f"""SELECT DISTINCT * FROM (SELECT ev AS s, '{BASE}Problem' AS o FROM prob UNION ALL SELECT ev, {_state('problem')} FROM prob
 UNION ALL SELECT ev, '{BASE}Action' FROM act UNION ALL SELECT ev, {_state('action')} FROM act
 UNION ALL SELECT {_node('section_name')}, '{BASE}System' FROM parts_catalog UNION ALL SELECT {_node('figure')}, '{BASE}Assembly' FROM parts_catalog
 UNION ALL SELECT {_node('has_function')}, '{BASE}Function' FROM component_functions UNION ALL SELECT {_node('sub_function_of')}, '{BASE}Function' FROM subfunction
 UNION ALL SELECT {_node('function_name')}, '{BASE}Function' FROM subfunction UNION ALL SELECT {_node('component')}, '{BASE}Component' FROM components
 UNION ALL SELECT {_node('label')}, {_node('k')} FROM kind) WHERE s IS NOT NULL AND o IS NOT NULL""",
    "lab": f"""SELECT DISTINCT * FROM (SELECT {_state('problem')} AS s, problem AS o FROM prob UNION ALL SELECT {_state('action')}, action FROM act
 UNION ALL SELECT {_node('section_name')}, section_name FROM parts_catalog UNION ALL SELECT {_node('figure')}, figure FROM parts_catalog
 UNION ALL SELECT {_node('has_function')}, has_function FROM component_functions UNION ALL SELECT {_node('sub_function_of')}, sub_function_of FROM subfunction
 UNION ALL SELECT {_node('function_name')}, function_name FROM subfunction UNION ALL SELECT {_node('k')}, k FROM kind) WHERE s IS NOT NULL AND o IS NOT NULL""",
    "sub": f"SELECT DISTINCT {_state('problem')} AS s, '{BASE}Problem' AS o FROM prob WHERE trim(problem) <> '' UNION SELECT {_state('action')}, '{BASE}Action' FROM act WHERE trim(action) <> ''",
    "des": "SELECT DISTINCT ev AS s, problem AS o FROM (SELECT DISTINCT ev, id FROM prob) p JOIN (SELECT ident, problem FROM idx) x ON x.ident = p.id WHERE problem IS NOT NULL UNION SELECT ev, log_text FROM act",
    "inv": f"SELECT DISTINCT * FROM (SELECT ev AS s, {_node('trim(part)')} AS o FROM prob UNION ALL SELECT ev, {_node('trim(part)')} FROM act) WHERE o IS NOT NULL",
    "loc": f"SELECT DISTINCT ev AS s, '{BASE}Cylinder' || d AS o FROM (SELECT ev, unnest(regexp_extract_all(cylinders, '\\d+')) AS d FROM (SELECT ev, cylinders FROM prob UNION ALL SELECT ev, cylinders FROM act))",
    "deal": f"SELECT DISTINCT ev AS s, '{BASE}problem-' || id AS o FROM act",
    "cat": f"SELECT *, CASE WHEN trim(part_number) <> '' THEN '{BASE}partnr-' || regexp_replace(part_number, '\\s', '_', 'g') END AS pn FROM parts_catalog",
    "po": f"SELECT DISTINCT * FROM (SELECT {_node('figure')} AS s, {_node('section_name')} AS o FROM cat UNION ALL SELECT pn, {_node('figure')} FROM cat UNION ALL SELECT pn, {_node('section_name')} FROM cat) WHERE s IS NOT NULL AND o IS NOT NULL",
    "num": "SELECT DISTINCT pn AS s, part_number AS o FROM cat WHERE pn IS NOT NULL",
    "hf": f"SELECT DISTINCT * FROM (SELECT {_node('component')} AS s, {_node('has_function')} AS o FROM component_functions) WHERE s IS NOT NULL AND o IS NOT NULL",
    "cd": f"SELECT DISTINCT * FROM (SELECT {_node('component')} AS s, {_node('depends_on')} AS o FROM dependson) WHERE s IS NOT NULL AND o IS NOT NULL",
    "fd": "SELECT DISTINCT a.o AS s, b.o AS o FROM cd JOIN hf a ON a.s = cd.s JOIN hf b ON b.s = cd.o",
    "sf": f"SELECT DISTINCT * FROM (SELECT {_node('function_name')} AS s, {_node('sub_function_of')} AS o FROM subfunction) WHERE s IS NOT NULL AND o IS NOT NULL",
}
_NEEDS = {"prob": ["idx"], "cleaned": ["idx"], "act": ["cleaned"], "ty": ["prob", "act", "kind"], "lab": ["prob", "act", "kind"], "sub": ["prob", "act"], "des": ["prob", "act"], "inv": ["prob", "act"], "loc": ["prob", "act"], "deal": ["act"], "po": ["cat"], "num": ["cat"], "fd": ["cd", "hf"]}


def with_(*names: str, more: str = "") -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join([f"{n} AS ({CTES[n]})" for n in order] + ([more] if more else [])) + "\n"


_B = BASE
_REACH = "r(s, o) AS (SELECT s, o FROM {t} UNION SELECT r.s, t.o FROM r JOIN {t} t ON t.s = r.o)"
_FROM = "r(o) AS (SELECT o FROM {t} WHERE s = '{x}' UNION SELECT t.o FROM r JOIN {t} t ON t.s = r.o)"
_TO = "r(s) AS (SELECT s FROM {t} WHERE o = '{x}' UNION SELECT t.s FROM r JOIN {t} t ON t.o = r.s)"
_SPF = f"{_B}SustainingPoweredFlight"
_NAME = "coalesce(l.o, regexp_replace({x}, '.+#', ''))"

ORACLES = {
    "kg_bind_const": with_("cd") + f"SELECT s AS c, o AS dep FROM cd WHERE s = '{_B}MainCrankAssembly'",
    "kg_bgp_const": with_("hf") + f"SELECT s AS c FROM hf WHERE o = '{_B}IsolatingValveLift'",
    "kg_object_join": with_("hf") + f"SELECT a.o AS f, b.s AS other FROM hf a JOIN hf b ON a.o = b.o WHERE a.s = '{_B}ExhaustTrunk'",
    "kg_values_join": with_("hf") + f"SELECT s AS c, o AS f FROM hf WHERE s IN ('{_B}MainCrankAssembly', '{_B}ExhaustTrunk')",
    "kg_bgp_star": with_("num", "po") + "SELECT DISTINCT po.o AS whole FROM num JOIN po ON po.s = num.s WHERE num.o = 'ZK-03516377-61'",
    "kg_filter_star": with_("num", "po", "ty") + f"SELECT num.s AS p, po.o AS whole FROM num JOIN po ON po.s = num.s WHERE po.o IN (SELECT s FROM ty WHERE o = '{_B}System') AND starts_with(num.o, 'TR') AND length(num.o) > 12",
    "kg_type_semi": with_("po", "ty") + f"SELECT s AS asm, o AS sys FROM po WHERE s IN (SELECT s FROM ty WHERE o = '{_B}Assembly') AND o IN (SELECT s FROM ty WHERE o = '{_B}System')",
    "kg_bgp_path": with_("ty", "sub", "loc") + f"SELECT ty.s AS problem, ty.o AS state FROM ty JOIN sub ON sub.s = ty.o JOIN loc ON loc.s = ty.s WHERE sub.o = '{_B}Problem' AND loc.o = '{_B}Cylinder2'",
    "kg_group_concat_distinct": with_("hf") + "SELECT o AS f, string_agg(s, ', ' ORDER BY s) AS list, count(*) AS n FROM hf GROUP BY o HAVING count(*) > 1",
    "kg_union_tagged": with_("sf", more=_TO.format(t="sf", x=_SPF) + f", u(o) AS (SELECT o FROM sf WHERE s = '{_SPF}' UNION SELECT t.o FROM u JOIN sf t ON t.s = u.o)") + "SELECT 'below' AS rel, s AS d FROM r UNION ALL SELECT 'above', o FROM u",
    "kg_path_plus_backward": with_("sf", "ty", more=_TO.format(t="sf", x=_SPF)) + f"SELECT s AS g FROM r WHERE s IN (SELECT s FROM ty WHERE o = '{_B}Function')",
    "kg_path_plus_forward": with_("cd", more=_FROM.format(t="cd", x=f"{_B}MainCrankAssembly")) + "SELECT o AS x FROM r",
    "kg_path_cycle_self": with_("sf", more=_REACH.format(t="sf")) + "SELECT s AS f FROM r WHERE s = o",
    "kg_path_seq_alt": with_("cd", "hf") + f"SELECT DISTINCT cd.s AS c, n.o AS x FROM cd JOIN (SELECT * FROM hf UNION SELECT * FROM cd) n ON n.s = cd.o WHERE cd.s = '{_B}ExhaustTrunk'",
    "kg_minus": with_("ty", "sf") + f"SELECT s AS f FROM ty WHERE o = '{_B}Function' AND s NOT IN (SELECT s FROM sf)",
    "kg_not_exists": with_("cd", "hf") + "SELECT DISTINCT s AS c FROM cd WHERE s NOT IN (SELECT s FROM hf)",
    "kg_critical": with_("hf", "fd", "ty") + f"SELECT hf.o AS f, count(DISTINCT fd.s) AS n FROM hf JOIN fd ON fd.o = hf.o WHERE hf.o IN (SELECT s FROM ty WHERE o = '{_B}Function') AND fd.s IN (SELECT s FROM ty WHERE o = '{_B}Function') GROUP BY 1",
    "kg_optional_label": with_("hf", "lab") + f"SELECT {_NAME.format(x='hf.o')} AS name, count(*) AS n FROM hf LEFT JOIN lab l ON l.s = hf.o GROUP BY 1",
    "kg_topk_types": with_("ty", "sub") + f"SELECT ty.o AS state, count(*) AS n FROM ty JOIN sub ON sub.s = ty.o WHERE sub.o = '{_B}Problem' GROUP BY 1 ORDER BY n DESC, state LIMIT 10",
    "kg_count_global": with_("ty") + f"SELECT count(*) AS n FROM ty WHERE o = '{_B}CrackedProblem'",
    "kg_topk_parts": with_("inv") + "SELECT o AS part, count(*) AS n FROM inv GROUP BY 1 ORDER BY n DESC, part LIMIT 10",
    "kg_select_distinct": with_("inv", "ty") + f"SELECT DISTINCT o AS part FROM inv WHERE s IN (SELECT s FROM ty WHERE o = '{_B}LeakingProblem')",
    "kg_values_actions": with_("inv", "ty", "deal") + f"SELECT DISTINCT a.o AS type FROM inv JOIN ty p ON p.s = inv.s AND p.o = '{_B}CrackedProblem' JOIN deal ON deal.o = inv.s JOIN ty a ON a.s = deal.s WHERE inv.o IN ('{_B}IntakeGasket', '{_B}WastegateClamp')",
    "kg_values_types": with_("inv", "ty") + f"SELECT DISTINCT inv.o AS part, ty.o AS type FROM inv JOIN ty ON ty.s = inv.s WHERE inv.o IN ('{_B}IntakeGasket', '{_B}WastegateClamp')",
    "kg_count_by_two_keys": with_("ty", "loc", "lab") + "SELECT ty.o AS type, loc.o AS location, count(*) AS n FROM ty JOIN loc ON loc.s = ty.s LEFT JOIN lab l ON l.s = loc.o GROUP BY 1, 2",
    "kg_topk_descriptions": with_("des", "ty") + f"SELECT o AS d, count(*) AS n FROM des WHERE s IN (SELECT s FROM ty WHERE o = '{_B}Problem') GROUP BY 1 ORDER BY n DESC, '\"' || replace(replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\"@en' LIMIT 10",
    "kg_both_locations": with_("ty", "loc") + f"SELECT s AS problem FROM loc WHERE o IN ('{_B}Cylinder2', '{_B}Cylinder4') AND s IN (SELECT s FROM ty WHERE o = '{_B}Problem') GROUP BY s HAVING count(DISTINCT o) = 2",
    "kg_actions_leaking": with_("ty", "loc", "deal", "des") + f"SELECT deal.s AS action, des.o AS d FROM deal JOIN des ON des.s = deal.s WHERE deal.o IN (SELECT s FROM ty WHERE o = '{_B}LeakingProblem') AND deal.o IN (SELECT s FROM loc WHERE o = '{_B}Cylinder4')",
    "kg_topk_part_types": with_("inv", "ty", "lab") + f"SELECT {_NAME.format(x='ty.o')} AS name, count(*) AS n FROM inv JOIN ty ON ty.s = inv.o LEFT JOIN lab l ON l.s = ty.o GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    "kg_topk_action_types": with_("deal", "ty", "lab") + f"SELECT {_NAME.format(x='ty.o')} AS name, count(*) AS n FROM deal JOIN ty ON ty.s = deal.s LEFT JOIN lab l ON l.s = ty.o GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    "kg_subselect": with_("cd", "ty") + f"SELECT s AS c, CAST(count(*) AS VARCHAR) AS n FROM cd WHERE s IN (SELECT s FROM ty WHERE o = '{_B}Component') GROUP BY s",
}
