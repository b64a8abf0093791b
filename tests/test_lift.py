from skylathe.functions.terms import BASE, slug, slug_py
from skylathe.plans import lift
from skylathe.plans.lift import LABEL, SUBCLASS, TYPE, name
from skylathe.streaming.events import lift_stream, stream_rows

SLUGS = {"Mixing and regulating fuel-air": "MixingAndRegulatingFuel-Air", "Connecting Rods, Pistons And Ring Assemblies": "ConnectingRodsPistonsAndRingAssemblies", "LEAKING problem": "LeakingProblem", "x_ray 3a blow-by": "X_Ray3ABlow-By", "": "", "é à": "ÉÀ"}


def triples(df):
    return {tuple(r) for r in df.collect()}


def test_slug(spark):
    df = spark.createDataFrame([(k,) for k in SLUGS], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", slug("t").alias("s")).collect()} == SLUGS
    assert {k: slug_py(k) for k in SLUGS} == SLUGS


def test_troubleshooting(spark):
    df = spark.createDataFrame([("Low oil", "Leak", "Seal it"), ("Low oil", "Leak", "Seal it"), ("Low oil", None, "Seal it")], "TROUBLE string, `PROBABLE CAUSE` string, REMEDY string")
    t = triples(lift.lift_troubleshooting(df))
    assert (name("LowOil"), name("hasCause"), name("Leak")) in t
    assert (name("SealIt"), name("addresses"), name("LowOil")) in t
    assert len(t) == 8


def test_catalog_closes_the_class_chain(spark):
    classes = spark.createDataFrame([("Bolt", "Fastener"), ("Fastener", "Hardware"), ("Odd", "Thing")], "Part string, subClassOf string")
    cat = spark.createDataFrame([("Sec", "Fig", "P-1", "Bolt", None), ("Sec", "Fig", "P-1", "Nut", "long")], "Section string, Figure string, `Part Number` string, Type string, Specifics string")
    t = triples(lift.lift_catalog(cat, classes))
    for s, o in (("Bolt", "Fastener"), ("Fastener", "Hardware"), ("Hardware", "Part"), ("Nut", "Part")):
        assert (name(s), SUBCLASS, name(o)) in t
    assert not any(s == name("Odd") for s, _, _ in t)
    p = f"<{BASE}partnr-P-1>"
    assert {o for s, q, o in t if s == p and q == name("partOf")} == {name("Fig"), name("Sec")}
    assert {o for s, q, o in t if s == p and q == LABEL} == {'"Bolt"', '"long"'}
    nan = triples(lift.lift_catalog(cat, classes, compat_nan_label=True))
    assert any(o.startswith('"NaN"') for _, _, o in nan)


def test_catalog_closes_a_long_class_chain(spark):
    classes = spark.createDataFrame([(f"K{i}", f"K{i + 1}") for i in range(80)], "Part string, subClassOf string")
    cat = spark.createDataFrame([("Sec", "Fig", "P-1", "K0", None)], "Section string, Figure string, `Part Number` string, Type string, Specifics string")
    t = triples(lift.lift_catalog(cat, classes))
    assert all((name(f"K{i}"), SUBCLASS, name(f"K{i + 1}")) in t for i in range(80))
    assert (name("K80"), SUBCLASS, name("Part")) in t


def test_function_cross_product(spark):
    fun = spark.createDataFrame([("A", "f1"), ("A", "f2"), ("B", "g1"), ("C", None)], "component string, has_function string")
    sub = spark.createDataFrame([("f1", "f2")], "sub_function_of string, function_name string")
    dep = spark.createDataFrame([("A", "B"), ("A", "C"), ("a", "b")], "component string, depends_on string")
    t = triples(lift.lift_functions(fun, sub, dep))
    deps = {(s, o) for s, p, o in t if p == name("dependsOn")}
    assert deps == {(name(s), name(o)) for s, o in (("A", "B"), ("A", "C"), ("F1", "G1"), ("F2", "G1"))}
    assert (name("F2"), name("subFunctionOf"), name("F1")) in t


ROWS = [("1", "GASKET", "2 4 2", "L/H", "LEAKING"), ("1", None, "", " ", ""), ("9", "X", "1", "R/H", "BAD")]
EXT = "id string, part string, cylinders string, engine string, problem string"


def logs(spark):
    raw = spark.createDataFrame([("1", "old", "fix", 1), ("1", "It leaks", "fixed", 2)], "ident string, problem string, action string, row_id bigint")
    return lift.log_index(raw)


def test_events(spark):
    t = triples(lift.lift_events(spark.createDataFrame(ROWS, EXT), logs(spark), "problem"))
    ev = f"<{BASE}problem-1>"
    assert (ev, lift.DESCRIPTION, '"It leaks"@en') in t  # the last record counts
    assert {o for s, p, o in t if s == ev and p == TYPE} == {name("Problem"), name("LeakingProblem")}
    assert {o for s, p, o in t if s == ev and p == name("atLocation")} == {name("Cylinder2"), name("Cylinder4"), name("EngineLh")}
    assert not any("problem-9" in s for s, _, _ in t)
    a = triples(lift.lift_events(spark.createDataFrame(ROWS, EXT.replace("problem", "action")), logs(spark), "action"))
    assert (f"<{BASE}action-unknown>", name("dealsWith"), f"<{BASE}problem-9>") in a


def test_stream_gives_the_same_triples(spark, tmp_path):
    df = spark.createDataFrame(ROWS, EXT)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    q = lift_stream(stream_rows(spark, str(tmp_path / "in"), EXT), logs(spark), "problem", str(tmp_path / "out"), str(tmp_path / "cp"), BASE)
    q.awaitTermination(120)
    got = {(r["s"], r["p"], r["o"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == triples(lift.lift_events(df, logs(spark), "problem"))
