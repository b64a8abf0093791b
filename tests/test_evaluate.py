import json

import pytest
from pyspark.sql import functions as F

from skylathe.functions.terms import RDF, RDFS
from skylathe.operators import prompts as P
from skylathe.operators.validation import Property, Shape, violations
from skylathe.plans import evaluate as E
from skylathe.plans.store import QuadStore
from skylathe.sources.rdf import parse_rdf

M = "https://example.org/m#"
Q1 = f"# Which parts does a need?\nPREFIX : <{M}>\nSELECT ?x WHERE {{ :a :needs ?x }}"
Q2 = f'# Who is named S-1?\nPREFIX : <{M}>\nSELECT ?x WHERE {{ ?x :name "S-1" }}'


@pytest.fixture(scope="module")
def store(spark):
    n = lambda x: f"<{M}{x}>"
    rows = [(n("a"), n("needs"), n("b")), (n("a"), n("needs"), n("c")), (n("b"), f"<{RDFS}label>", '"Bee"'), (n("c"), n("needs"), n("d")), (n("d"), n("name"), '"S-1"'), (n("z"), n("needs"), n("y"))]
    return QuadStore(spark.createDataFrame([("<g>", *r) for r in rows], "g string, s string, p string, o string"))


def settings(**kw):
    return E.Settings(base=M, prefixes={"m": M}, **kw)


def test_context(store):
    c = E.context_of(store, "q1", Q1, settings())
    assert (c.question, c.columns, sorted(c.gold)) == ("Which parts does a need?", ["x"], [[M + "b"], [M + "c"]])
    assert c.seeds == [f"{M}a", f"{M}needs"] and c.triples == 4
    assert c.predicates[0] == {"predicate": f"{M}needs", "count": 3}
    d = E.context_of(store, "q2", Q2, settings())
    assert f"{M}d" in d.seeds and '"S-1"' in d.text
    assert E.context_of(store, "q1", Q1, settings(depth=None)).triples == 6


def test_questions_above_a_size_are_refused(store):
    for bound in ({"most_rows": 1}, {"most_triples": 3}):
        with pytest.raises(ValueError):
            E.context_of(store, "q1", Q1, settings(**bound))


def test_runs_scores_and_cache(store):
    replies = {"Which parts does a need?": '```json\n{"columns": ["x"], "rows": [["bee"], ["m:q"]]}\n```', "Who is named S-1?": "sorry"}
    calls = []

    def responder(messages, seed):
        calls.append(seed)
        return next(v for k, v in replies.items() if k in messages[1]["content"])

    cache: dict = {}
    r = E.evaluate(store, [("q1", Q1), ("q2", Q2)], settings(cache_only=False, runs=2, seed=5, seed_step=2), cache, responder)
    by = {(q["run"], q["question"]): q for q in r["questions"]}
    assert (by[0, "q1"]["tp"], by[0, "q1"]["fp"], by[0, "q1"]["fn"]) == (1, 1, 1)
    assert (by[0, "q2"]["tp"], by[0, "q2"]["fn"]) == (0, 1)
    assert calls == [5, 5, 7, 7]
    assert r["summary"]["macro_f1"] == {"mean": 0.25, "std": 0.0}
    assert "| 0 | q1 | 0.5000 |" in E.evaluation_markdown(r)
    again = E.evaluate(store, [("q1", Q1)], settings(), json.loads(json.dumps(cache)))
    assert again["questions"][0]["tp"] == 1
    with pytest.raises(FileNotFoundError):
        E.evaluate(store, [("q1", Q1)], settings())
    with pytest.raises(ValueError):
        settings(lenience=2)
    with pytest.raises(ValueError):
        settings(runs=0)


def test_profiles_cost_and_turtle(store, tmp_path):
    s = settings(model="Some/Model 1", lenience=0.5)
    c = [E.context_of(store, "q1", Q1, s)]
    assert s.label == "subgraph-d1-some-model-1-l0.5"
    assert E.write_profiles(c, str(tmp_path / "p"))["q1"]["triple_count"] == 4
    cost = E.estimate_cost(c, s, {}, "0.001", "1")
    assert cost["would_call"] == 1 and cost["cost"].startswith("1.")
    assert E.estimate_cost(c, s, {E.key_of(c[0], s): {}}, None, None) == {"model": "Some/Model 1", "requests": 1, "would_call": 0, "prompt_tokens": 0, "cost": None}
    E.write_turtle(store.triples(), str(tmp_path / "x.ttl"), {"": M, "rdfs": RDFS})
    back = {t[1:] for t in parse_rdf((tmp_path / "x.ttl").read_text(), "x")}
    assert back == {tuple(r) for r in store.triples().collect()}


def test_shapes(spark):
    t = f"<{RDF}type>"
    rows = [("<a>", t, "<A>"), ("<a>", "<p>", "<b>"), ("<a>", "<p>", "<c>"), ("<b>", t, "<B>"), ("<a>", "<odd>", '"x"'), ("<a>", "<q>", '"lit"'), ("<n>", "<p>", "<a>")]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    v = violations(df, [Shape("<A>", [Property("<p>", cls="<B>", most=1), Property("<q>", resource=True)], closed=True)])
    assert {tuple(r) for r in v.collect()} == {("<a>", "<p>", "<c>", "class"), ("<a>", "<p>", None, "maxCount"), ("<a>", "<q>", '"lit"', "nodeKind"), ("<a>", "<odd>", '"x"', "closed")}


def test_prompts(spark, tmp_path):
    df = spark.createDataFrame([("b (hot)", 1), ("a", 2), ("b (hot)", 3), (None, 4)], "c string, n int")
    assert list(P.bullets(df, "c", "n")) == ["- b (hot)\n- a"]
    assert [r["x"] for r in df.orderBy("n").limit(2).select(P.cause_stem(F.col("c")).alias("x")).collect()] == ["b", "a"]
    assert list(P.bullets(df, "c", "n", block=1)) == ["- b (hot)", "- a"]
    assert list(P.bullets(df.limit(0), "c", "n")) == []
    P.save_tsv("```tsv\nA\tB\n1\t2\n```", str(tmp_path / "t.tsv"))
    assert (tmp_path / "t.tsv").read_text() == "A\tB\n1\t2\n"
    assert P.unfence("plain") == "plain"
    for text in (P.component_prompt("d", "- s", "- a"), P.dependency_prompt(), P.failure_prompt("- t", "- c")):
        assert "header" in text
