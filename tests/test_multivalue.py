import pytest
from pyspark.sql import functions as F

from skylathe.operators.multivalue import explode_values, packed_numbers, packed_values


def split(spark, text, f=packed_values):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A; B", ["A", "B"]), ("A ;B;", ["A", "B"]), ("A, ,B", ["A", "B"]), ("A|B & C + D", ["A", "B", "C", "D"]), ("A and B AND C", ["A", "B", "C"]),
        ("A/B / C", ["A", "B", "C"]), ("L/H ENG / R/H ENG", ["L/H ENG", "R/H ENG"]), ('NUT 5/8" AF', ['NUT 5/8" AF']), ('X; "NUT 5/8"" AF"', ["X", 'NUT 5/8" AF']),
        ('"GASKET, ROCKER"', ["GASKET, ROCKER"]), ("'BOLT; LONG' | Z", ["BOLT; LONG", "Z"]), ('["A","B, C"]', ["A", "B, C"]), ('["A";"SEAL 7/16"""]', ["A", 'SEAL 7/16"']),
        ("A\tB\nC", ["A", "B", "C"]), ("A;A;A", ["A", "A", "A"]), ("SANDY AND BRAND", ["SANDY", "BRAND"]), ('"open; X', ['"open', "X"]), ("", []), (" ; , ", []),
        ("a0;ba", ["a0", "ba"]), ('"p;q";0', ["p;q", "0"]), ("x" * 20000 + ";y", ["x" * 20000, "y"]),
    ],
)
def test_values(spark, text, want):
    assert split(spark, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("1&4", ["1", "4"]), ("#1/2/3", ["1", "2", "3"]), ("3 5 6 3", ["3", "5", "6", "3"]), ("CYL 2; NO. 4", ["2", "4"]), ("[1, 2]", ["1", "2"]), ("all", ["ALL"]), ('"1";"2"', ["1", "2"]), ("1,,2,", ["1", "2"]), ("9, 9 AND 8", ["9", "9", "8"]), ("", []), ('"1", "2"', ["1", "2"]), ("(1) [2]", ["1", "2"]), ("CYL#3 CYL. 4", ["3", "4"]), ("5A, FRONT;1-4", ["5A", "FRONT", "1-4"]), ("'7'/cylinder 8 and no. 9", ["7", "8", "9"]), ("All; 1", ["ALL", "1"])],
)
def test_numbers(spark, text, want):
    assert split(spark, text, packed_numbers) == want


def test_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "A;B", 7), (2, None, 7), (3, "A", 7), (1, "A;B", 7)], "row_id int, part string, pos int")
    got = sorted(tuple(r) for r in explode_values(df, "t", "part", packed_values(F.col("part"))).collect())
    assert got == sorted([("t", "part", 1, 1, "A"), ("t", "part", 1, 2, "B")] * 2)
    assert explode_values(df.limit(0), "t", "part", packed_values(F.col("part"))).count() == 0


def test_written_and_read_back(spark):
    """Values joined with random separators and quotes come back in order."""
    import random

    rnd = random.Random(8)
    plain = ["OIL PUMP", "L/H ENG #2", "R/H ENG", "SEAL 1/2 IN", "BAND", "A-B (C)", "x.y"]
    tricky = ["GASKET, ROCKER", "BOLT; LONG", "SEAL & RING", 'NUT 5/8" AF', "COVER | TOP", "A AND B", "TAB\tIN"]
    seps = ["; ", ";", ", ", ",", " | ", "|", " & ", " + ", " AND ", " and ", "\n", "\t", " / ", ";;", ", ,", " ;"]
    rows = []
    for i in range(400):
        values = [rnd.choice(plain + tricky) for _ in range(rnd.randint(1, 5))]
        quote = lambda v: '"' + v.replace('"', '""') + '"' if v in tricky or rnd.random() < 0.2 else v
        text = values and quote(values[0])
        for v in values[1:]:
            text += rnd.choice(seps) + quote(v)
        text += rnd.choice(["", ";", " ", ","])
        if rnd.random() < 0.2:
            text = "[" + ",".join('"' + v.replace('"', '""') + '"' for v in values) + "]"
        rows.append((i, text, values))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", packed_values(F.col("t")).alias("v")).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: v for i, _, v in rows}
