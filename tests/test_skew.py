from skylathe.operators.skew import heavy_keys, skew_join


def test_heavy_keys_have_a_bound(spark):
    df = spark.createDataFrame([("a", 60), ("b", 30), ("c", 1), (None, 500)], "k string, n int")
    assert heavy_keys(df, ["k"], "n", share=0.04, floor=10) == [("a",), ("b",)]
    assert heavy_keys(df, ["k"], "n", share=0.5, floor=10) == []
    assert heavy_keys(df.limit(0), ["k"], "n") == []


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), (None, 2), ("z", 3)], "k string, v int")
    right = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, w string")
    for how in ("left", "inner"):
        plain = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, skew_join(left, right, ["k"], [("a",)], how).collect())) == plain
