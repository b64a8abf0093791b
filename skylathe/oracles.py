"""The core queries in SQL, for comparison with an independent engine. Keys as in ``queries.QUERIES``."""

_KEY = "nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"

_REFS = " UNION ALL ".join(
    f"SELECT '{t}' AS ref_table, '{c}' AS ref_field, row_id, {_KEY.format(c=c)} AS k, loaded_at AS lt FROM {t}"
    for t, c in (("dependson", "component"), ("dependson", "depends_on"), ("component_functions", "component"))
)
_ORPHAN = f"""NOT EXISTS (SELECT 1 FROM (SELECT {_KEY.format(c='component')} AS ck, registered_at, removed_at FROM components) g
 WHERE g.ck = r.k AND g.registered_at <= r.lt AND (g.removed_at IS NULL OR r.lt < g.removed_at))"""

# walks of nodes with a loop above never end, so loops are found on the closure as a set, without distances
_SETS = f"""WITH RECURSIVE pairs AS (SELECT {_KEY.format(c='sub_function_of')} AS p, {_KEY.format(c='function_name')} AS c FROM subfunction),
names AS (SELECT p AS name FROM pairs WHERE p IS NOT NULL UNION SELECT c FROM pairs WHERE c IS NOT NULL),
links AS (SELECT c, min(p) AS p FROM pairs WHERE c IS NOT NULL GROUP BY c HAVING min(p) IS NOT NULL),
up(name, anc) AS (SELECT c, p FROM links UNION SELECT u.name, l.p FROM up u JOIN links l ON l.c = u.anc),
onloop AS (SELECT name FROM up WHERE name = anc),
lo AS (SELECT u.name, min(u.anc) AS low FROM up u JOIN onloop o ON o.name = u.name GROUP BY u.name),
walk(name, anc, dist) AS (SELECT name, name, 0 FROM names UNION ALL SELECT w.name, l.p, w.dist + 1 FROM walk w JOIN links l ON l.c = w.anc WHERE w.anc NOT IN (SELECT name FROM onloop)),
top AS (SELECT name, max(dist) AS d, max_by(anc, dist) AS root FROM walk GROUP BY name)"""

# sizes of subtrees, the child that continues its parent's chain, chains and places on them
_CHAINS = f"""{_SETS},
sz AS (SELECT anc AS name, count(*) AS size FROM walk GROUP BY 1),
kid AS (SELECT p, c FROM (SELECT l.p, l.c, row_number() OVER (PARTITION BY l.p ORDER BY size DESC, l.c) AS r FROM links l JOIN sz ON sz.name = l.c WHERE l.c NOT IN (SELECT name FROM onloop)) WHERE r = 1),
ch(name, head, pos) AS (SELECT name, name, 0 FROM names WHERE name NOT IN (SELECT c FROM kid) UNION ALL SELECT k.c, ch.head, ch.pos + 1 FROM ch JOIN kid k ON k.p = ch.name),
tied AS (SELECT t.name, lo.low FROM top t JOIN lo ON lo.name = t.root)"""

# tokens of a field: quoted spans, words with what follows them, white space, single signs; separators part them
_TOKEN = r"""'"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[0-9A-Za-z_]*[0-9](?:/[0-9]+)+["'']*|[LRlr]/[Hh]\b|[0-9A-Za-z_]+["'']*|\s+|(?s:.)'"""
_PACKED = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS field_name, row_id, regexp_extract_all(CASE WHEN x LIKE '[%]' THEN x[2:-2] ELSE x END, {_TOKEN}) AS toks
 FROM (SELECT row_id, regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS x FROM {t} WHERE {c} IS NOT NULL)"""
    for t, c in (("aircraft_annotation_datafile", "part"), ("aircraft_annotation_datafile", "location"))
)
_PIECES = f"""p AS (SELECT row_number() OVER () AS k, * FROM ({_PACKED})),
u AS (SELECT k, table_name, field_name, row_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM p),
sep AS (SELECT *, tok IN (';', ',', '|', '&', '+', '/') OR regexp_matches(tok, '^\\s*[\\t\\r\\n]\\s*$')
 OR (upper(tok) = 'AND' AND regexp_matches(coalesce(lag(tok) OVER w, ''), '^\\s+$') AND regexp_matches(coalesce(lead(tok) OVER w, ''), '^\\s+$')) AS cut FROM u WINDOW w AS (PARTITION BY k ORDER BY i)),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY k ORDER BY i) AS n FROM sep),
whole AS (SELECT k, table_name, field_name, row_id, n, trim(string_agg(tok, '' ORDER BY i)) AS item FROM g WHERE NOT cut GROUP BY ALL),
bare AS (SELECT k, table_name, field_name, row_id, n, trim(CASE WHEN regexp_full_match(item, '"(?:[^"]|"")*"') THEN replace(item[2:-2], '""', '"')
 WHEN regexp_full_match(item, '''(?:[^'']|'''')*''') THEN replace(item[2:-2], '''''', '''') ELSE item END) AS item FROM whole),
cyl AS (SELECT row_id, list_filter(regexp_split_to_array(regexp_replace(upper(cylinders), '[^A-Z0-9;,|&+/\\s]', '', 'g'), '[;,|&+/\\s]+'), lambda x: x NOT IN ('', 'AND', 'CYL', 'NO')) AS v FROM problem_extractions_regex)"""

ORACLES = {
    "p5_found": f"""WITH {_PIECES}, r AS (SELECT table_name, field_name, row_id, row_number() OVER (PARTITION BY k ORDER BY n) AS pos, item, count(*) OVER (PARTITION BY k) AS m FROM bare WHERE item <> '')
 SELECT table_name, field_name, row_id, pos, item FROM r WHERE m > 1
 UNION ALL SELECT 'problem_extractions_regex', 'cylinders', row_id, generate_subscripts(v, 1), regexp_replace(unnest(v), '^(CYL|NO)', '') FROM cyl WHERE len(v) > 1""",
    "p1_found": f"SELECT ref_table, ref_field, row_id FROM ({_REFS}) r WHERE k IS NOT NULL AND {_ORPHAN}",
    "p1_orphan_counts": f"""SELECT ref_table, ref_field, strftime(lt, '%Y-%m') AS period, count(*) AS n_refs,
 CAST(sum(CASE WHEN {_ORPHAN} THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans FROM ({_REFS}) r WHERE k IS NOT NULL GROUP BY ALL""",
    "p4_found": f"""{_SETS} SELECT t.name AS function_name, coalesce(lo.low, t.root) AS root_name, CAST(t.d AS BIGINT) AS depth,
 CAST(CASE WHEN lo.name IS NULL THEN 0 WHEN t.d = 0 THEN 1 ELSE 2 END AS BIGINT) AS cycle_state
 FROM top t LEFT JOIN lo ON lo.name = t.root""",
    "p4_paths": f"""{_SETS} SELECT name AS function_name, string_agg(anc, ' > ' ORDER BY dist DESC) AS path FROM walk GROUP BY name""",
    "p4_descendants": f"""{_CHAINS} SELECT ch.name AS function_name, 'chain' AS chain_kind, ch.head AS chain_name, CAST(ch.pos AS BIGINT) AS first,
 CAST(e.last AS BIGINT) AS last, sz.size - 1 AS n_below FROM ch JOIN (SELECT head, max(pos) AS last FROM ch GROUP BY 1) e ON e.head = ch.head
 JOIN sz ON sz.name = ch.name WHERE ch.name NOT IN (SELECT name FROM onloop)
 UNION ALL SELECT o.name, 'loop', lo.low, 0, 0, n FROM onloop o JOIN lo ON lo.name = o.name JOIN (SELECT low, count(*) AS n FROM tied GROUP BY 1) k ON k.low = lo.low""",
    "p4_members": f"""{_CHAINS} SELECT w.name AS function_name, 'chain' AS chain_kind, ch.head AS chain_name, CAST(max(ch.pos) AS BIGINT) AS place
 FROM walk w JOIN ch ON ch.name = w.anc GROUP BY ALL UNION ALL SELECT name, 'loop', low, 0 FROM tied""",
}
