import math
import random

import pytest
from pyspark.sql import functions as F

from skylathe.functions.terms import RDFS
from skylathe.operators import retrieval as R
from skylathe.operators import scoring as S
from skylathe.operators.closure import closure, superclasses


def answers(spark, gold, pred):
    rows = [("q", "gold", i, list(c)) for i, c in enumerate(gold)] + [("q", "pred", i, list(c)) for i, c in enumerate(pred)]
    return spark.createDataFrame(rows, "question string, side string, row_no int, cells array<string>")


@pytest.mark.parametrize("seed", range(3))
def test_exact_is_greedy_without_budget(spark, seed):
    rnd = random.Random(seed)
    gold, pred = ([(rnd.choice("ab"), rnd.choice("xy")) for _ in range(8)] for _ in range(2))
    a = answers(spark, gold, pred)
    e, g = S.score_exact(a, ["question"]).first(), S.score_lenient(a, ["question"], 0).first()
    assert e["tp"] == g["tp"] == S.greedy(gold, pred, 0)
    one = S.score_lenient(a, ["question"], 1).first()
    assert one["tp"] == S.greedy(gold, pred, 1) and one["fp"] == 8 - one["tp"]


def test_metrics_at_the_edges(spark):
    q = spark.createDataFrame([("q",), ("none",)], "question string")
    r = {x["question"]: x for x in S.score_exact(answers(spark, [("a",)], []), ["question"], questions=q).collect()}
    assert (r["none"]["precision"], r["none"]["f1"]) == (1.0, 1.0)
    assert (r["q"]["precision"], r["q"]["recall"], r["q"]["f1"]) == (0.0, 0.0, 0.0)
    empty = S.macro_micro(S.score_exact(answers(spark, [("a",)], []).limit(0), ["question"])).first()
    assert math.isnan(empty["macro_f1"]) and empty["micro_f1"] == 0.0
    assert S.mismatch_budget(3, 0.5) == 1
    with pytest.raises(ValueError):
        S.mismatch_budget(3, 1.5)


def test_mean_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    r = {x["k"]: (x["mean"], round(x["std"], 6)) for x in S.mean_std(df, "v", ["k"]).collect()}
    assert r == {"a": (1.0, 0.0), "b": (2.0, 1.414214)}


def test_canonical_order_of_rules(spark):
    lab = f"<{RDFS}label>"
    t = spark.createDataFrame([("<u:x#One>", lab, '"First  thing"'), ("<u:x#Two>", lab, '"same"'), ("<u:x#Three>", lab, '"Same"')], "s string, p string, o string")
    values = [" <http://a/b> ", "HTTPS://a", "p:n", "first thing", "two", "same", " Other  Value ", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["canonical"] for r in S.canonical(df, "v", S.unique_labels(t), S.unique_local_names(t), {"p": "u:p#"}).collect()}
    assert [got[v] for v in values] == ["http://a/b", "HTTPS://a", "u:p#n", "u:x#One", "u:x#Two", "same", "other value", ""]


def test_small_columns(spark):
    def one(c, v):
        return spark.createDataFrame([(v,)], "t string").select(c.alias("x")).first()["x"]

    assert one(S.strip_fences(F.col("t")), "```json\n[1]\n```") == "json\n[1]"
    assert one(S.strip_fences(F.col("t")), " plain ") == "plain"
    assert one(S.estimate_tokens(F.col("t")), "abc") == 1
    assert one(S.request_cost(F.lit(10), F.lit("0.5"), F.lit("1")), "x") == 6
    assert one(S.request_cost(F.lit(10), F.lit(None).cast("string"), F.lit("1")), "x") is None
    assert len(one(S.cache_key(F.col("t")), "x")) == 64


def test_cache_and_records(spark):
    req = spark.createDataFrame([("k1", "p", ["a"], 1), ("kx", "p", ["a"], 2), ("ky", "none", ["a"], 1)], "key string, path string, columns array<string>, gold_size int")
    cache = spark.createDataFrame([("k1", "p", ["z"], [["1"]]), ("k2", "p", ["a"], [["2"]]), ("k3", "p", ["a"], [["3"], ["4"]])], "key string, path string, columns array<string>, rows array<array<string>>")
    got = {r["key"]: r["answer_rows"] for r in S.cached_answers(req, cache).collect()}
    assert got == {"k1": [["1"]], "kx": [["3"], ["4"]], "ky": None}
    replies = spark.createDataFrame([(1, '{"records": [{"id": "7", "cylinders": [1, 2]}, {"id": "8"}]}'), (2, "no json"), (3, '{"records": 5}'), (4, None)], "batch int, reply string")
    rec = S.parse_records(replies, "reply", "records", "id string, cylinders array<int>", ["batch"]).collect()
    assert [(r["batch"], r["id"], r["cylinders"]) for r in rec] == [(1, "7", [1, 2]), (1, "8", None)]
    out = S.respond(replies, "reply", lambda ps: ["-" if p is None else p[:2] for p in ps], "short").collect()
    assert {r["short"] for r in out} == {'{"', "no", "-"}


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")]


def test_closure_over_a_loop(spark):
    e = spark.createDataFrame(EDGES, "s string, o string")
    want = {(x, y) for x in "abc" for y in "abcd"}
    assert {tuple(r) for r in closure(e).collect()} == want
    assert {tuple(r) for r in closure(e, spark.createDataFrame([("b",)], "s string")).collect()} == {p for p in want if p[0] == "b"}
    assert {tuple(r) for r in closure(e, spark.createDataFrame([("d",)], "o string"), backward=True).collect()} == {p for p in want if p[1] == "d"}
    assert closure(e.limit(0)).count() == 0
    up = {(r["s"], r["o"]): r["depth"] for r in superclasses(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "s string, o string")).collect()}
    assert up == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "b"): 2, ("c", "b"): 1, ("c", "c"): 2}


def test_superclasses_of_long_chains_and_loops(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("c10", "c40"), ("c120", "end")]
    loop = [(f"l{i}", f"l{(i + 1) % 97}") for i in range(97)] + [("c5", "l0")]
    up, want = {}, {}
    for s, o in chain + loop:
        up.setdefault(s, set()).add(o)
    for s in up:
        level, depth = up[s], 1
        while level:
            want.update({(s, o): depth for o in level})
            level, depth = {x for o in level for x in up.get(o, ()) if (s, x) not in want}, depth + 1
    got = superclasses(spark.createDataFrame(chain + loop + [(None, "c0")], "s string, o string")).collect()
    assert {(r["s"], r["o"]): r["depth"] for r in got} == want and len(got) == len(want)
    assert want[("c0", "c150")] == 121 and want[("l0", "l0")] == 97


def test_khop_and_telemetry(spark):
    t = [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<q>", '"x"'), ("<d>", "<p>", "<a>"), ("<e>", "<q>", "_:n"), ("<z>", "<p>", "<z>")]
    df = spark.createDataFrame(t, "s string, p string, o string")
    seeds = spark.createDataFrame([("<a>",)], "n string")
    assert {tuple(r) for r in R.khop(df, seeds, 1).collect()} == {t[0], t[1], t[3]}
    assert {tuple(r) for r in R.khop(df, seeds, 0).collect()} == {t[0], t[1], t[3]}
    assert {tuple(r) for r in R.khop(df, seeds, 2).collect()} == {t[0], t[1], t[2], t[3]}
    assert R.khop(df, seeds.limit(0), 1).count() == 6
    assert {tuple(r) for r in R.predicate_breakdown(df, 1).collect()} == {("p", 4), ("__other__", 2)}
    assert {tuple(r) for r in R.term_types(df).collect()} == {("subject", "uri", 6), ("object", "uri", 4), ("object", "literal", 1), ("object", "bnode", 1)}
    assert R.seed_names(':A rdf:type :B-c "x"', "u:") == ["<u:A>", "<u:B>", "<u:type>"]
    lit = spark.createDataFrame([("<a>", "<u:n>", '"S-1"'), ("_:b", "<u:n>", '"S-1"')], "s string, p string, o string")
    assert [r["seed"] for r in R.literal_seeds(lit, '?x :n "S-1"', "u:").collect()] == ["<a>"]
    assert R.retrieval_text([], 1).endswith("seeds=[UNSEEDED (full union graph)])")


@pytest.mark.parametrize("few", [200_000, 0])
def test_khop_of_repeated_triples(spark, monkeypatch, few):
    monkeypatch.setattr(R, "BROADCAST_ROWS", few)
    t = [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<q>", '"x"'), ("<d>", "<p>", "<a>"), (None, "<p>", "<z>"), ("<z>", "<p>", None), (None, "<p>", "<a>")]
    df = spark.createDataFrame(t * 3, "s string, p string, o string")
    got = [tuple(r) for r in R.khop(df, spark.createDataFrame([("<a>",)], "n string")).collect()]
    assert sorted(got, key=str) == sorted([t[0], t[1], t[3], t[6]], key=str)
