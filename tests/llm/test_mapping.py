import random

import pytest

from skylathe.llm.mapping import Index, Rules, code_of, distance, map_values, read, skeleton, word_match, words_of
from skylathe.llm.queries import NAME, NUMBER

PARTS = ["ROCKER COVER BRACKET", "WASTEGATE CLAMP", "INTAKE GASKET", "OIL COOLER BAFFLE", "FUEL PUMP MOUNT", "FLYWHEEL MOUNT", "IDLER FITTING", "OIL FILTER SEAL", "AIR FILTER SEAL", "CRANKCASE FLANGE"]
CODES = ["HD-92484-72455", "TR6279-496017", "201-TR-4230763", "ZK-41079-34853"]
LISTS = [(i + 1, "part", p) for i, p in enumerate(PARTS)] + [(i + 100, "code", c) for i, c in enumerate(CODES)]
RULES = {"part": NAME, "code": NUMBER}


def mapped(spark, values, lists=LISTS, **kw):
    v = spark.createDataFrame([(f, i, x, "a") for i, (f, x) in enumerate(values)], "field_name string, row_id bigint, value string, item_id string")
    c = spark.createDataFrame([(*x, 9) for x in lists], "item_id bigint, list_name string, label string, value int")
    return {r["row_id"]: r["item_id"] for r in map_values(v, c, RULES, **kw).collect()}


MEANT = {
    "rocker-cover brackets": 1, "RCKR CVR BRCKT": 1, "BRACKET, ROCKER COVER": 1, "Rocker Cvr Brkt": 1, "WSTGT CLMP": 2, "\tthe wategate clamp.": 2, "WASTEGATECLAMP": 2, "#3 CYL INTAKE GASKET": 3, "intake gaskte S/N 1234": 3,
    "NEW L/H OIL COOLER BAFFLE (?)": 4, "FL PMP MNT": 5, "flywheel miubt": 6, "c/case flange": 10, "SEAT BELT": 0, "N/A": 0, "xx": 0, "TOW BAR": 0, "FILTER SEAL": 0, "idler": 0,
}


@pytest.mark.parametrize("kw", [{}, {"block": 3}, {"block": 0, "share": 0.0, "least": 0.0}, {"floor": 1}])
def test_words(spark, kw):
    got = mapped(spark, [("part", v) for v in MEANT], **kw)
    assert {v: got[i] for i, v in enumerate(MEANT)} == MEANT


CODE = {"hd-92484-72455": 100, "P/N HD 92484 72455 REV A": 100, "HD-99484-72455": 100, "hd924847245": 100, "tr6279496017 (new)": 101, "#201.TR.423O763*": 102, "2O1-TR-4230736": 102, "zk-4i079-34853": 103, "ZK-99999-34853": 0, "HD-92484-00000": 0, "5444052058": 0}


@pytest.mark.parametrize("kw", [{}, {"block": 3}])
def test_codes(spark, kw):
    got = mapped(spark, [("code", v) for v in CODE], **kw)
    assert {v: got[i] for i, v in enumerate(CODE)} == CODE


def test_exact_blank_and_repeated(spark):
    got = mapped(spark, [("part", "INTAKE GASKET"), ("part", None), ("part", "  "), ("part", "intake gasket"), ("part", "intake gasket"), ("code", "INTAKE GASKET"), ("part", "z" * 5000), ("part", "!!!")])
    assert got == {3: 3, 4: 3, 5: 0, 6: 0, 7: 0}


def all_pairs(value, entries, rules):
    """The value against every entry, whatever n-grams they share."""
    ix = Index(entries, rules)
    words = read(value, rules)
    if not words:
        return 0
    vector = ix.vector(words)
    cos = [sum(w * u.get(g, 0.0) for g, w in vector.items()) for u in map(ix.vector, ix.words)]
    at, first, second = ix.two_best((ix.ids[k], ix.score(words, ix.words[k], ix.weights[k], ix.letters[k], cos[k])) for k in range(len(ix.ids)))
    return at if first >= rules.threshold and first - second >= rules.margin else 0


def slips(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        k = rnd.randrange(len(PARTS))
        s = list(PARTS[k])
        i = rnd.randrange(1, len(s) - 1)
        op = rnd.choice("dsit")
        if op == "d":
            del s[i]
        elif op == "s":
            s[i] = rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        elif op == "i":
            s.insert(i, s[i])
        else:
            s[i], s[i + 1] = s[i + 1], s[i]
        yield "".join(s).lower(), k + 1


@pytest.mark.parametrize("kw", [{}, {"block": 0}, {"share": 0.0, "least": 0.0}])
def test_against_all_pairs(spark, kw):
    values = [("part", v) for v, _ in slips(60)] + [("part", v) for v in MEANT] + [("code", v) for v in CODE]
    entries = {name: [(i, x) for i, n, x in LISTS if n == name] for name in RULES}
    got = mapped(spark, values, **kw)
    assert [got[i] for i in range(len(values))] == [all_pairs(v, entries[f], RULES[f]) for f, v in values]


def test_no_words_are_built_in(spark):
    plain = {"part": Rules(), "code": Rules(code=True)}
    v = spark.createDataFrame([("part", 1, "intake gaskte"), ("part", 2, "left oil cooler baffle"), ("code", 3, "hd 92484 72455")], "field_name string, row_id bigint, value string")
    c = spark.createDataFrame([*LISTS, (50, "part", "LEFT MAGNETO")], "item_id bigint, list_name string, label string")
    assert {r["row_id"]: r["item_id"] for r in map_values(v, c, plain).collect()} == {1: 3, 2: 4, 3: 100}
    assert words_of("THE LEFT ENGINE") == ["THE", "LEFT", "ENGINE"]


def test_empty_sides(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, [("part", "intake gasket")], lists=[]) == {0: 0}


def test_held_out_typos(spark):
    cases = list(slips(300))
    got = mapped(spark, [("part", v) for v, _ in cases])
    assert sum(got[i] == k for i, (_, k) in enumerate(cases)) >= 0.98 * len(cases)


def test_distance_against_the_whole_table():
    def whole(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(6)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("ABC") for _ in range(rnd.randrange(7))) for _ in range(2))
        most = rnd.randrange(4)
        assert distance(a, b, most) == min(whole(a, b), most + 1)


def test_pieces():
    assert words_of("#4 CYL L/H oil_cooler  S/N 77", NAME, True) == ["LH", "OIL", "COOLER"]
    assert code_of("PN: ZK-4O1 rev b", NUMBER) == code_of("zk401", NUMBER)
    assert skeleton("FITTING") == "FTNG"
    assert [distance(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("abc", "ab"), ("abcdef", "a"))] == [0, 1, 1, 1, 3]
    assert word_match("GASKETS", "GASKET") > 0.95 and word_match("BELT", "GASKET") == 0.0
