import random

import pyarrow as pa
import pytest
from compare import DATA

from skylathe.functions.terms import RDF, XSD, escape, unescape
from skylathe.io_queries import context_hash
from skylathe.sources import sinks
from skylathe.sources.rdf import RdfError, parse_rdf, read_directory, read_files
from skylathe.sources.sinks import canonical_lines, stable_hash, stable_text, text_hash, trig_blocks, write_ntriples

TTL = """@prefix : <https://example.org/m#> . @base <https://example.org/b/> .
# a comment
:a a :T ; :p "x"@en, 'y', 1, 1.5, 1e0, true ; :q <rel> .
:b :has [ :c :d ; :s 2 ] , "multi
" .
[] :p ( :x :y ) .
:l\\,x :p \"\"\"long "quoted" text\"\"\"^^:dt .
""".replace('"multi\n"', '"multi"')


def test_turtle_terms():
    q = {(s, p, o) for _, s, p, o in parse_rdf(TTL, "f.ttl")}
    m = "<https://example.org/m#%s>"
    assert (m % "a", f"<{RDF}type>", m % "T") in q
    objects = {o for s, p, o in q if s == m % "a" and p == m % "p"}
    assert objects == {'"x"@en', '"y"', f'"1"^^<{XSD}integer>', f'"1.5"^^<{XSD}decimal>', f'"1e0"^^<{XSD}double>', f'"true"^^<{XSD}boolean>'}
    assert (m % "a", m % "q", "<https://example.org/b/rel>") in q
    assert (m % "l,x", m % "p", '"long \\"quoted\\" text"^^' + m % "dt") in q
    assert sum(p == f"<{RDF}first>" for _, p, _ in q) == 2
    assert sum(s.startswith("_:") and p == m % "s" for s, p, _ in q) == 1


def test_trig_graphs_and_ntriples():
    q = parse_rdf("@prefix : <u:> . <u:g> { :a :p :b ; :q :c . :d :p :e } GRAPH :h { :a :p :b . } :z :p :z .", "t.trig")
    assert [g for g, *_ in q] == ["<u:g>"] * 3 + ["<u:h>", "<file:t.trig>"]
    assert parse_rdf('<u:a> <u:p> "x\\n" <u:g> .\n_:b <u:p> _:b .\n', "n.nq")[0] == ("<u:g>", "<u:a>", "<u:p>", '"x\\n"')


@pytest.mark.parametrize("bad", ["<u:a> <u:p>", "@prefix : <u:> . :a x:b :c .", ":a :b :c .", "<u:a> <u:p> { } ."])
def test_errors(bad):
    with pytest.raises((RdfError, ValueError)):
        parse_rdf(bad, "x")


def test_directory(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<u:a> <u:p> _:x . _:x <u:p> <u:b> .")
    (tmp_path / "b.trig").write_text("<u:g> { <u:a> <u:p> _:x . }")
    (tmp_path / "broken.ttl").write_text("<u:a> <u:p>")
    (tmp_path / "extractions_c.ttl").write_text("<u:c> <u:p> <u:c> .")
    (tmp_path / "note.txt").write_text("no graph")
    assert read_directory(spark, str(tmp_path)).count() == 4
    assert read_directory(spark, str(tmp_path), exclude_prefix="extractions_").count() == 3
    blanks = {r["o"] for r in read_directory(spark, str(tmp_path)).filter("o like '_:%'").collect()}
    assert len(blanks) == 2  # scoped to their file
    with pytest.raises(Exception, match="broken"):
        read_directory(spark, str(tmp_path), on_error="raise").count()
    with pytest.raises(FileNotFoundError):
        read_directory(spark, str(tmp_path / "none"))
    assert read_files(spark, []).count() == 0


def test_round_trips(spark, tmp_path):
    rows = [("<u:g>", "<u:a>", "<u:p>", '"x\\"y\\n"@en'), ("<u:g>", "<u:a>", "<u:p>", "<u:b>"), ("<u:g>", "<u:a>", "<u:q>", '"1"^^<u:t>'), ("<u:h>", "<u:b>", "<u:p>", "<u:b>")]
    df = spark.createDataFrame(rows, "g string, s string, p string, o string")
    text = "\n".join(r["block"] for r in trig_blocks(df).collect())
    assert sorted(parse_rdf(text, "t")) == sorted(rows)
    write_ntriples(df, str(tmp_path / "nt"))
    lines = "\n".join(p.read_text() for p in (tmp_path / "nt").glob("part-*"))
    assert len(parse_rdf(lines, "n")) == 4


def test_canonical_text_ignores_blank_names(spark):
    def text(a, b):
        rows = [("<u:s>", "<u:p>", a), (a, "<u:q>", '"1"'), ("<u:s>", "<u:p>", b), (b, "<u:q>", '"2"')]
        return stable_text(spark.createDataFrame(rows, "s string, p string, o string"))

    assert text("_:x", "_:y") == text("_:n7", "_:a") != ""
    assert canonical_lines(spark.createDataFrame([("<u:b>", "<u:p>", "<u:c>")], "s string, p string, o string")).first()["line"] == "<u:b> <u:p> <u:c> ."
    assert stable_text(spark.createDataFrame([], "s string, p string, o string")) == ""


def ring(*sizes):
    out, k = [], 0
    for n in sizes:
        out += [(f"_:b{k + i}", "<u:next>", f"_:b{k + (i + 1) % n}") for i in range(n)]
        k += n
    return out


def graph_text(spark, triples, seed=None):
    if seed is not None:
        names = sorted({x for t in triples for x in (t[0], t[2]) if x.startswith("_:")})
        new = dict(zip(names, random.Random(seed).sample([f"_:x{i}" for i in range(len(names))], len(names))))
        triples = [(new.get(s, s), p, new.get(o, o)) for s, p, o in triples]
    return stable_text(spark.createDataFrame(triples, "s string, p string, o string"))


def test_blank_nodes_are_never_merged(spark):
    six, three, mixed = ring(6), ring(3, 3), ring(6, 3, 3)
    assert len(graph_text(spark, six).splitlines()) == len(graph_text(spark, three).splitlines()) == 6
    assert graph_text(spark, six) != graph_text(spark, three)
    for g in (six, mixed, ring(3) + [("_:b0", "<u:p>", '"x"')], [(f"_:n{i}", "<u:p>", "<u:o>") for i in range(4)]):
        assert graph_text(spark, g, 1) == graph_text(spark, g, 2)
        assert len(graph_text(spark, g).splitlines()) == len(g)


def test_literals_come_back(spark):
    texts = ["\ue010", "a\\nb", "\\", "\\\\n", '"\n\t\r', "", "\\\ue010\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["u"] for r in df.select(unescape(escape("t")).alias("u")).collect()] == texts


def test_hash_of_a_graph_is_taken_off_the_driver(spark, monkeypatch):
    """As the hash of its text: over several partitions and repeated lines, with blank nodes, and of no triples."""
    many = [(f"<u:{k % 97}>", "<u:p>", f'"{k} é\U0001f600"') for k in range(500)]
    for rows in (many * 2, ring(6, 3, 3) + [("<u:a>", "<u:p>", "_:b0")], []):
        df = spark.createDataFrame(rows, "s string, p string, o string").repartition(5)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [r["hash"] for r in stable_hash(df).collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == [text_hash(stable_text(df))]
    sent, frame = [], type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.append(rows := collect(self)) or rows)
    assert context_hash(spark, str(DATA)).count() == 1
    assert max((len(r) for r in sent), default=0) <= 1


def test_blocks_are_told_apart(monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 4)
    lines = pa.RecordBatch.from_pydict({"line": ["ab", "ab", "cd", "ef"]})
    out = [r for b in sinks._blocks(iter([lines, pa.RecordBatch.from_pydict({"line": ["ef", "g"]})])) for r in b.to_pylist()]
    assert out == [{"first": "ab", "text": "ab\ncd\n"}, {"first": "ef", "text": "ef\ng\n"}]
