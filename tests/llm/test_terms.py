import random
import re
from collections import Counter

import pytest

from skylathe.llm import terms as M
from skylathe.llm.terms import BurstTrie, count_terms


def brute(rows, field):
    value = lambda t: " ".join(t.split()).upper()
    texts = [t for t in rows if t is not None and value(t)]
    total, recs = Counter(), Counter()
    for t in texts:
        words = [w.upper() for w in re.findall("[A-Za-z0-9]+", t)]
        for w, n in Counter(words).items():
            total["term", w] += n
            recs["term", w] += 1
        total["value", value(t)] += 1
        recs["value", value(t)] += 1
    mark = lambda n: "rare" if n < 3 else "common" if n * 20 > len(texts) else "kept"
    return {(field, u, i, total[u, i], recs[u, i], mark(recs[u, i])) for u, i in total}


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "part string, problem string, item string, n_total int")


def rows(seed, n=400):
    rnd = random.Random(seed)
    words = ["GASKET", "gasket", "Gas-ket", "ÖL", "a b", "ab", "abc", "", " ", None, "x" * 300, "1", "\t q  q "]
    return [(rnd.choice(words) if rnd.random() < 0.3 else f"{rnd.choice('abc')}{rnd.randrange(60)} {rnd.choice(['CRACK', 'crack'])}", rnd.choice(["LEAK"] * 9 + ["Bad  seal"])) for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"route_entries": 5}])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, kw, monkeypatch):
    data = rows(seed)
    got = {tuple(r) for r in count_terms(frame(spark, data).repartition(3), ["part", "problem"], **kw).collect()}
    assert got == brute([a for a, _ in data], "part") | brute([b for _, b in data], "problem")


def test_flushed_tries_give_the_same(spark):
    data = rows(3)
    f = M._count(["part", "problem"])
    pdf = frame(spark, data).select("part", "problem").toPandas()
    old, M.TRIE_ENTRIES = M.TRIE_ENTRIES, 20
    try:
        parts = list(f(iter([pdf[:100], pdf[100:250], pdf[250:]])))
    finally:
        M.TRIE_ENTRIES = old
    assert len(parts) > 2
    n = Counter()
    for p in parts:
        for r in p.itertuples():
            for s, t in zip(r.suffixes, r.totals):
                n[r.field_name, r.unit, r.prefix + s] += t
    want = brute([a for a, _ in data], "part") | brute([b for _, b in data], "problem")
    assert n == Counter({(f_, u, i): t for f_, u, i, t, _, _ in want})


def test_routes_are_small_and_agree(spark):
    words = ["COMMON LONG PREFIX"] * 3 + [f"COMMON LONG PREFIX {a}{b}" for a in "XY" for b in range(30)] + ["Q", ""]
    rows = [("part", "value", "", False, [w for w in words[i:] + words[:i]][: 40 + i], [1] * (40 + i), [1] * (40 + i)) for i in range(1, 20)]
    rows += [("part", "value", "COMMON LONG PREFIX X1", False, ["", "7"], [1, 1], [1, 1])] * 9
    tries = spark.createDataFrame(rows, M.SCHEMA)
    placed = M._routed(tries, 15).collect()
    sizes, of, n = Counter(), {}, Counter()
    for r in placed:
        sizes[r["route"], r["closed"]] += len(r["suffixes"])
        for s, t in zip(r["suffixes"], r["totals"]):
            item = r["prefix"] + s
            assert item.startswith(r["route"]) and of.setdefault(item, r["route"]) == r["route"]
            n[item] += t
    assert all(k <= 15 or closed for (_, closed), k in sizes.items())
    assert n == Counter(x for r in rows for x in (r[2] + s for s in r[4]))


def test_trie_merges_containers_of_any_depth():
    rnd = random.Random(8)
    want, t = Counter(), BurstTrie()
    for _ in range(6):
        one, n = BurstTrie(), Counter(f"{rnd.choice(['', 'a', 'ab'])}{rnd.randrange(700)}" for _ in range(rnd.choice([50, 900])))
        for k, c in n.items():
            one.add(k, c, 1)
        want += n
        for prefix, held in one.containers():
            t.merge(prefix, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()])
    assert {p + s: c[0] for p, held in t.containers() for s, c in held.items()} == dict(want) and t.entries == len(want)


def test_trie_bursts_and_keeps_ends():
    t = BurstTrie()
    items = [f"{a}{b}" for a in ("", "a", "ab", "abc") for b in range(400)] + ["", "a", "ab"]
    for i in items * 2:
        t.add(i, 2, 1)
    got = {p + s: tuple(c) for p, held in t.containers() for s, c in held.items()}
    assert got == {i: (4, 2) for i in set(items)} | {i: (4 * items.count(i), 2 * items.count(i)) for i in set(items)}
    assert max(len(h) for _, h in t.containers()) <= M.BURST


def test_empty(spark):
    assert count_terms(frame(spark, []), ["part", "problem"]).count() == 0
    assert count_terms(frame(spark, [(None, " ")]), ["part", "problem"]).count() == 0
