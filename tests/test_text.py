import pytest
from pyspark.sql import functions as F

from skylathe.operators import extraction as X
from skylathe.operators import linking as L
from skylathe.operators import tagging as G

PROBLEMS = {
    "L/H ENG #2 INTAKE GASKET IS LEAKING": ("L/H ENG #2", "INTAKE GASKET", "", "LEAKING", "", ""),
    "#3 CYL ROCKER COVER GASKETS LEAKING OIL": ("#3 CYL ", "ROCKER COVER GASKET", "", "LEAKING", "", "OIL"),
    "R/H ENG AFT BAFFLE CRACKED ON #4 CYL": ("R/H ENG ", "AFT BAFFLE", "", "CRACKED", "#4 CYL", ""),
    "ENGINE BAFFLE SEAL HAS A TORN EDGE": ("", "ENGINE BAFFLE SEAL", "", "TORN", "", "EDGE"),
    "#1 & 3 ROCKER COVERS, LEAKING": ("#1 & 3", "ROCKER COVER", "", "LEAKING", "", ""),
    "ALL CYL LOW COMPRESSION": ("ALL ", "CYL", "", "LOW COMPRESSION", "", ""),
    "INTAKE TUBE LOOSE, CYL 2": ("", "INTAKE TUBE", "", "LOOSE", "CYL 2", ""),
    "oil cooler bracket is broken": ("", "oil cooler bracket", "", "broken", "", ""),
    "ROUTINE INSPECTION": (None,) * 6,
}
ACTIONS = {
    "REPLACED #2 INTAKE GASKET": ("REPLACED", "#2", "INTAKE GASKET"), "TIGHTENED ROCKER COVER SCREWS": ("TIGHTENED", "", "ROCKER COVER SCREW"), "REMOVED & REPLACED #4 CYL GASKET W/ NEW PART": ("REPLACED", "#4 CYL ", "GASKET"),
    "STOP DRILLED BAFFLE CRACK, OPS OK": ("STOP DRILLED", "", "BAFFLE CRACK"), "CLEANED L/H ENG #1 SPARK PLUGS": ("CLEANED", "L/H ENG #1", "SPARK PLUG"), "REPLACED NEW BAFFLE SEAL": ("REPLACED", "", "BAFFLE SEAL"), "NO DEFECT NOTED": (None,) * 3,
}


@pytest.mark.parametrize(("table", "groups"), [(PROBLEMS, X.problem_groups), (ACTIONS, X.action_groups)])
def test_grammars(spark, table, groups):
    df = spark.createDataFrame([(t,) for t in table], "t string")
    assert {r[0]: tuple(r[1:]) for r in df.select("t", *groups(F.col("t"))).collect()} == table


def one(spark, expr, **v):
    return spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(expr.alias("x")).first()["x"]


def test_columns(spark):
    assert one(spark, X.clean_log(F.col("t")), t="..A. ") == "A."
    assert one(spark, X.clean_log(F.col("t")), t="A.\n") == "A."
    assert one(spark, X.clean_log(F.col("t"), True), t=None) == "nan"
    assert one(spark, X.clean_location(F.col("t")), t="R/H ENG #4 CYL, (2)") == "R/H 4 2"
    assert one(spark, X.clean_location(F.col("t")), t="ALL CYL") == "1 2 3 4"
    assert one(spark, X.clean_location(F.col("t")), t="ENG #") is None
    assert one(spark, X.cylinder_digits(F.col("t")), t="R 4 2 2") == "2 4"
    assert one(spark, X.join_locations(F.col("a"), F.col("b"), F.col("c")), a="#3 ", b=" ", c="CYL") == "#3  CYL"
    assert one(spark, X.label_values(F.col("t")), t="a, b;c ; ;nan") == ["a, b", "c"]
    assert one(spark, X.label_values(F.col("t")), t="a, b") == ["a", "b"]


def test_extraction_end_to_end(spark):
    logs = spark.createDataFrame([("7", "R/H ENG INTAKE GASKETS LEAKING.", "REPLACED #2 GASKET"), ("8", None, None), ("9", "ODD THING LOOSE", "")], "ident string, problem string, action string")
    classes = spark.createDataFrame([("GASKET",)], "Part string")
    got = {r["id"]: tuple(r)[1:] for r in X.extract_problems(logs, classes, tail=0).collect()}
    assert got == {"7": ("INTAKE GASKET", "LEAKING", "", "", "R/H"), "8": ("", "", "", "", ""), "9": ("", "LOOSE", "", "", "")}
    acts = {r["id"]: tuple(r)[1:] for r in X.extract_actions(logs, classes, tail=0).collect()}
    assert acts["7"] == ("REPLACED", "GASKET", "2", "")


def test_whitelist_tail_and_batches(spark):
    parts = spark.createDataFrame([("A X",), ("B X",), ("C Y",), ("D Z",), ("E Z",), (None,)], "part string")
    classes = spark.createDataFrame([("Q",)], "Part string")
    assert {r["head"] for r in X.head_whitelist(parts, classes, tail=2).collect()} == {"Q", "X", "Z"}
    b = X.batches(spark.createDataFrame([(i,) for i in range(45)], "n int"), "n", 20).collect()
    assert sorted((r["batch"], len(r["rows"])) for r in b) == [(0, 20), (1, 20), (2, 5)]
    assert [x["n"] for x in min(b)["rows"]] == list(range(20))


LEMMAS = {"gaskets": "gasket", "tubes": "tub", "assemblies": "assembly", "hoses": "hose", "glass": "glass", "valves": "valv", "bushes": "bush"}


def test_lemmas(spark):
    df = spark.createDataFrame([(k,) for k in LEMMAS], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", L.lemma(F.col("t")).alias("x")).collect()} == LEMMAS


def test_linking_against_plain_python(spark):
    import math

    cat = [(1, "fuel section", "fig one", "P1", "pump", "long drive"), (2, "oil section", "fig two", "P2", "pump", "short"), (3, "oil section", "fig two", "P2", "pump", "short drive"), (4, "other", "f", "P4", "bolt", "")]
    df = spark.createDataFrame(cat, "id int, a string, b string, n string, t string, s string")
    c = L.normalise_catalog(df, "a", "b", "n", "t", "s", "id")
    m = spark.createDataFrame([("FUEL PUMP",), ("OIL DRIVE PUMPS",), ("NOTHING",)], "mention string")
    docs = {i: f"{a} {b} {t} {s}".split() for i, a, b, _, t, s in cat}
    idf = {w: math.log((1 + 4) / (1 + sum(w in d for d in docs.values()))) + 1 for d in docs.values() for w in d if len(w) > 1}

    def vec(words):
        v = {w: words.count(w) * idf[w] for w in words if w in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    want = {}
    for men, q in (("FUEL PUMP", ["fuel", "pump"]), ("OIL DRIVE PUMPS", ["drive", "oil", "pumps"])):
        for i in (1, 2, 3):
            s = sum(x * vec(docs[i]).get(w, 0) for w, x in vec(q).items())
            if s > 0:
                want[men, i] = round(s, 9)
    got = {(r["mention"], r["order"]): round(r["score"], 9) for r in L.score(m, c).collect()}
    assert got == want


def test_drop_and_shares(spark):
    rows = [("m", 1, "A", 0.8), ("m", 2, "B", 0.7), ("m", 3, "B", 0.6), ("m", 4, "C", 0.1), ("m", 5, "D", 0.09), ("one", 1, "A", 0.5)]
    s = spark.createDataFrame(rows, "mention string, order int, part_number string, score double")
    got = {(r["mention"], r["part_number"]): r["confidence"] for r in L.cut_at_drop(s).collect()}
    assert got == {("m", "A"): round(0.8 / 2.1, 5), ("m", "B"): round(0.6 / 2.1, 5), ("one", "A"): 1.0}
    best = L.simplify(L.cut_at_drop(s)).collect()
    assert {r["mention"]: r["part_number"] for r in best} == {"m": "A", "one": "A"}


def test_mapping_rows_and_quads(spark, tmp_path):
    from skylathe.sources.sinks import mapping_quads, write_sssom

    links = spark.createDataFrame([("Oil Pump", "P-1", 0.75)], "mention string, part_number string, confidence double")
    cat = spark.createDataFrame([("P-1", "second", 2), ("P-1", "first", 1)], "part_number string, label string, order int")
    rows = L.mapping_rows(links, cat, "t v1", "src.csv", "abc", "2024-01-01")
    r = rows.first()
    assert (r["mapping_id"], r["object_label"], r["mapping_notes"]) == ("kg:mapping/oil_pump--p_1", "first", "oil")
    write_sssom(rows, str(tmp_path / "m.tsv"), {"license": "x"})
    lines = "".join(f.read_text() for f in sorted((tmp_path / "m.tsv").glob("part-*"))).splitlines()
    assert lines[0] == "#license: x" and len(lines) == 3
    assert mapping_quads(rows, "https://example.org/m#", "https://example.org/g", "2024-01-01T00:00:00Z").count() == 14


def test_tagging(spark, tmp_path):
    df = spark.createDataFrame([("1", "INTAKE GASKET LEAKING at INTAKE GASKET", "L/H ENG", "INTAKE GASKET; INTAKE GASKET", "LEAKING"), ("2", "intake gasket leaking", None, "INTAKE GASKET", "nan"), ("3", " ", None, "X", None)], "ident string, problem string, location string, part string, tggedproblem string")
    a = {r["ident"]: [(s["start"], s["label"]) for s in r["spans"]] for r in G.annotate(df).collect()}
    assert a == {"1": [(0, "part"), (25, "part"), (14, "tggedproblem")], "2": [(0, "part")]}
    model = G.train_tagger(G.annotate(df))
    assert [(r["phrase"], r["label"], r["n"]) for r in model.collect()] == [("intake gasket", "part", 3)]
    tagged = {r["id"]: r["part"] for r in G.tag(df, model).collect()}
    assert tagged == {"1": "INTAKE GASKET", "2": "intake gasket"}
    G.save_model(model, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    phrases = spark.createDataFrame([("intake", "location"), ("intake gasket", "part"), ("gasket leaking", "part"), ("leaking", "tggedproblem")], "phrase string, label string")
    assert [tuple(r)[2:] for r in G.tag(df.filter("ident = '2'"), phrases).collect()] == [("", "intake gasket", "leaking")]
    assert {r["part"] for r in G.tag(df, phrases.limit(0)).collect()} == {""}
    train, test = G.train_test(df)
    assert train.count() + test.count() == 3


def test_perceptron_on_held_out_lines(spark):
    import random

    rnd = random.Random(4)
    places, parts, faults = ["#1 CYL", "#2 CYL", "R/H ENG", "NOSE BOWL", "TOP DECK"], ["INTAKE GASKET", "OIL COOLER", "ROCKER COVER", "WASTEGATE CLAMP", "BAFFLE"], ["LEAKING", "CRACKED", "WORN OUT", "LOOSE", "CHAFED"]
    rows = []
    for i in range(500):
        p, q, f = rnd.choice(places), rnd.choice(parts), rnd.choice(faults)
        rows.append((str(i), rnd.choice([f"{p} {q} {f}.", f"{q} AT {p} IS {f}", f"FOUND {f} {q} ON {p}, REPAIRED"]), p, q, f))
    df = spark.createDataFrame(rows, "ident string, problem string, location string, part string, tggedproblem string")
    train, test = df.filter("int(ident) < 300"), df.filter("int(ident) >= 300")
    model = G.train_perceptron(G.annotate(train), rows=250)
    got = {r["id"]: (r["location"], r["part"], r["tggedproblem"]) for r in G.tag_perceptron(test, model).collect()}
    want = {r[0]: r[2:] for r in rows[300:]}
    assert sum(got[i] == w for i, w in want.items()) >= 0.95 * len(want)
    # a part that was never annotated is told by what stands around it
    new = spark.createDataFrame([("x", "#2 CYL SPINNER MOUNT LEAKING.", None, None, None), ("y", " ", None, None, None), ("z", None, None, None, None)], df.schema)
    assert [(r["id"], r["part"]) for r in G.tag_perceptron(new, model).collect()] == [("x", "SPINNER MOUNT")]
    assert {r["part"] for r in G.tag_perceptron(new, model.limit(0)).collect()} == {""}
    empty = G.train_perceptron(G.annotate(df.limit(0)))
    assert empty.count() == 0
