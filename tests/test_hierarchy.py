import random

import pytest

from skylathe.operators import hierarchy as H
from skylathe.operators.hierarchy import hierarchy


def build(spark, pairs):
    return hierarchy(spark.createDataFrame([(p, c, 1, "z") for p, c in pairs], "parent string, child string, id int, name string"), "parent", "child")


def brute(pairs):
    key = lambda s: " ".join((s or "").split()).lower()
    up, names = {}, set()
    for p, c in pairs:
        p, c = key(p), key(c)
        names |= {x for x in (p, c) if x}
        if p and c:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in names:
        walk, x = [n], n
        while x in up and up[x] not in walk:
            x = up[x]
            walk.append(x)
        if x in up:
            loop = walk[walk.index(up[x]) :]
            out[n] = (min(loop), walk.index(loop[0]), 1 if n in loop else 2)
        else:
            out[n] = (x, len(walk) - 1, 0)
    return out


def found(h):
    return {r["function_name"]: (r["root_name"], r["depth"], r["cycle_state"]) for r in h.found().collect()}


def test_small_forest_with_loops(spark):
    pairs = [("R", "a"), ("r", "A "), ("a", "b"), ("b", "c"), (None, "R"), ("", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("y", "t"), ("t", "u"), ("s", "s"), ("s", "v"), ("only", None), (None, "lone"), (None, None), ("r", "a")]
    assert found(build(spark, pairs)) == brute(pairs)


@pytest.mark.parametrize("seed", range(2))
def test_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(0, i + (i % 9 == 0))}", f"N{i}") for i in range(1, 60)] + [("hub", f"leaf {i}") for i in range(40)] + [(f"d{i}", f"d{i + 1}") for i in range(40)]
    assert found(build(spark, pairs)) == brute(pairs)


def test_hot_parents_are_split(spark, monkeypatch):
    monkeypatch.setattr(H.lookup, "__defaults__", ("left", 5, None))
    pairs = [("hub", f"leaf{i}") for i in range(60)] + [("top", "hub"), ("hub", "mid"), ("mid", "end")]
    assert found(build(spark, pairs)) == brute(pairs)


def closure(pairs):
    """Pairs of a name and each name that can be reached from it."""
    key = lambda s: " ".join((s or "").split()).lower()
    up, names = {}, set()
    for p, c in pairs:
        p, c = key(p), key(c)
        names |= {x for x in (p, c) if x}
        if p and c:
            up[c] = min(p, up.get(c, p))
    out = set()
    for n in names:
        x, seen = n, set()
        while x in up and up[x] not in seen:
            x = up[x]
            seen.add(x)
        out |= {(a, n) for a in seen}
    return out


FORESTS = [
    [("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("y", "w")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "z"), ("s", "s"), ("s", "t"), (None, "lone"), ("m", "u"), ("n", "u"), ("M ", "U")],
    [(f"n{(i * 7) % max(1, i - 1 - i % 5)}", f"n{i}") for i in range(2, 70)] + [(f"d{i}", f"d{i + 1}") for i in range(20)] + [("d9", f"e{i}") for i in range(5)],
]


@pytest.mark.parametrize("pairs", FORESTS)
def test_descendants_and_paths(spark, pairs):
    h = build(spark, pairs)
    want = closure(pairs)
    below = [tuple(r) for r in h.below().collect()]
    assert len(below) == len(set(below)) and set(below) == want
    n = {r["function_name"]: r["n_below"] for r in h.intervals().collect()}
    assert {k: v for k, v in n.items() if v} == {a: sum(1 for x, _ in want if x == a) for a, _ in want}
    found_, paths = brute(pairs), {r["function_name"]: r["path"].split(" > ") for r in h.paths().collect()}
    assert set(paths) == set(found_) and h.paths().count() == len(paths)
    for name, p in paths.items():
        assert p[-1] == name and len(p) == found_[name][1] + 1 and all((a, b) in want for a, b in zip(p, p[1:]))
    some = spark.createDataFrame([("b",), ("b",)], "function_name string")
    assert {tuple(r) for r in h.below(some).collect()} == {x for x in want if x[0] == "b"}


def test_further_parents_are_returned(spark):
    assert [tuple(r) for r in build(spark, FORESTS[1]).dropped.collect()] == [("u", "n")]
    assert build(spark, FORESTS[0]).dropped.count() == 0


def test_segments_are_few(spark):
    h = build(spark, [(f"n{i // 2}", f"n{i}") for i in range(1, 64) if i // 2 != i])
    assert max(len(r["segments"]) for r in h.places.collect()) <= 7


def test_empty_and_blank(spark):
    assert found(build(spark, [])) == {}
    assert found(build(spark, [(None, ""), (" ", None)])) == {}
    assert found(build(spark, [("", "a")])) == {"a": ("a", 0, 0)}
