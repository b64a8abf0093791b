import json
from datetime import UTC, datetime

import pytest

from skylathe.plans import report
from skylathe.plans.store import QuadStore
from skylathe.sources import sinks as K
from skylathe.sources import tables as T


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿IDENT,TEXT\n1,"a, ""b""\nc"\n1,\n2,x\n', encoding="utf-8")
    df = T.read_csv(spark, str(p))
    assert df.columns == ["IDENT", "TEXT"]
    assert [tuple(r) for r in df.collect()] == [("1", 'a, "b"\nc'), ("1", None), ("2", "x")]
    assert [r["TEXT"] for r in T.keep_empty(df).collect()][1] == ""
    (tmp_path / "b.tsv").write_text("A\tB\n1\t2\n")
    assert [tuple(r) for r in T.read_tsv(spark, str(tmp_path / "b.tsv"), ["x", "y"]).collect()] == [("1", "2")]
    K.write_csv(df, str(tmp_path / "out"))
    assert T.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (" ", 3, "x")], "k string, n int, v string")
    assert {r["k"]: r["v"] for r in T.first_rows(df, "k", "n").collect()}["a"] == "early"
    assert [tuple(r) for r in T.first_seen(df, "k", "n").collect()] == [("a", 1)]
    assert T.number_rows(df, "n").count() == 3


def test_queries_and_caches(tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.rq").write_text("# Which?\nASK {}")
    (tmp_path / "a.rq").write_text("ASK {}")
    assert [(c, n) for c, n, _ in T.find_queries(str(tmp_path))] == [(".", "a"), ("c", "b")]
    assert len(T.find_queries(str(tmp_path), recursive=False)) == 1
    assert T.question_of("# Which?\nASK {}") == "Which?"
    assert T.question_of("ASK {}", "stem") == "stem"
    with pytest.raises(ValueError):
        T.question_of("ASK {}")
    with pytest.raises(FileNotFoundError):
        T.find_queries(str(tmp_path / "no"))
    path = str(tmp_path / "x.json")
    assert T.load_json(path) == {}
    K.save_json({"b": 1, "a": [2]}, path)
    assert T.load_json(path) == {"a": [2], "b": 1}
    (tmp_path / "x.json").write_text("{")
    assert T.load_json(path) == {}
    with pytest.raises(ValueError):
        T.load_json(path, strict=True)
    with pytest.raises(FileNotFoundError):
        T.load_json(path + "x", strict=True)


def test_catalog_round_trip(spark, tmp_path):
    c = K.data_catalog(["d/a.ttl", "d/b.trig", "d/c.csv"], "https://example.org/x", "n", "lic", ["q/one_two.rq", "q/no.txt"])
    assert c["hasPart"][0]["name"] == "one two" and len(c["hasPart"]) == 1
    K.save_json(c, str(tmp_path / "catalog.json"))
    got = {(r["url"], r["media_type"]) for r in T.read_catalog(spark, str(tmp_path / "catalog.json")).collect()}
    assert got == {("https://example.org/x/d/a.ttl", "text/turtle"), ("https://example.org/x/d/b.trig", "application/trig")}
    assert K.join_url("https://a/", "https://b/c") == "https://b/c"
    with pytest.raises(ValueError):
        K.data_catalog([], "u", "n")
    assert T.price_table(spark, [("m", 0.1, None)]).count() == 1


def test_provenance(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("1")
    b.write_text("2")
    now = datetime(2024, 1, 1, tzinfo=UTC)
    rec = K.prov_record("step", [str(a)], [str(b)], now, now, "https://example.org/")
    assert json.loads(json.dumps(rec))["@graph"][0]["@id"] == "https://example.org/run/step/20240101T000000"
    assert K.up_to_date(rec, [str(a)], [str(b)])
    a.write_text("changed")
    assert not K.up_to_date(rec, [str(a)], [str(b)])
    assert not K.up_to_date({}, [str(b)], [])
    assert K.text_hash("x") == K.text_hash("x") != K.text_hash("y")


def test_reports_and_charts(spark):
    st = QuadStore(spark.createDataFrame([("<g>", "<u:a>", "<u:p>", "<u:bC_d>")], "g string, s string, p string, o string"))
    runs = [report.execute(st, "c", n, n, q) for n, q in (("good", "SELECT ?s { ?s <u:p> ?o }"), ("none", "SELECT ?s { ?s <u:x> ?o }"), ("bad", "SELECT"))]
    assert [o.status for o in runs] == ["pass", "empty", "error"]
    assert report.status_counts(runs) == {"pass": 1, "empty": 1, "error": 1}
    assert "| good | pass | 1 |" in report.markdown(runs)
    assert set(report.as_json(runs)) == {"c/good", "c/none", "c/bad"}
    df = spark.createDataFrame([("u:x#bigOne", "7", 1), ("u:x#two_b", "9", 2), ("z", None, 3)], "name string, itemCount string, n int")
    assert report.numeric_columns(df) == ["itemCount", "n"]
    assert report.value_column(df) == "itemCount"
    assert report.chart_rows(df) == [("two b", 9.0), ("big One", 7.0)]
    assert report.chart_rows(df, top=1) == [("two b", 9.0)]
    assert report.chart_rows(df, least=8) == [("two b", 9.0)]
    with pytest.raises(ValueError):
        report.value_column(df.select("name"))
    assert len(report.shorten("x" * 200)) == 120
    kind, shown = K.serialise(df)
    assert kind == "solutions" and shown.count() == 3
    assert K.serialise(True) == ("boolean", True)
    assert K.serialise(st.triples())[0] == "graph"


def test_result_form_is_one_document(spark, tmp_path):
    from skylathe.sources.sinks import write_result

    rows = [("<u:a>", '"x"@en'), ("_:b", None), ("<u:c>", '"3"^^<u:int>')]
    df = spark.createDataFrame(rows, "s string, o string").repartition(3)
    for name, part in (("three", df), ("none", df.limit(0))):
        write_result(part, str(tmp_path / name))
        doc = json.loads("".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))))
        assert doc["head"]["vars"] == ["s", "o"] and len(doc["results"]["bindings"]) == part.count()
        if name == "three":
            by = {b["s"]["value"]: b for b in doc["results"]["bindings"]}
            assert by["u:a"]["o"] == {"type": "literal", "value": "x", "xml:lang": "en"} or by["u:a"]["o"]["xml:lang"] == "en"
            assert by["b"] == {"s": {"type": "bnode", "value": "b"}} and by["u:c"]["o"]["datatype"] == "u:int"


def test_row_numbers_are_total(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1009 AS n", "1 AS row_no_before").repartition(7)
    got = [(r["n"], r["row_no"]) for r in T.number_rows(df, "n").orderBy("n").collect()]
    assert [k for _, k in got] == list(range(1, 1001))
    assert T.number_rows(df.limit(0), "n").count() == 0
