from leafsieve.operators.heavy import heavy_hitters


def test_frequent_values_are_named(spark):
    rows = [("hot",)] * 500 + [("warm",)] * 60 + [(f"v{i}",) for i in range(800)]
    df = spark.createDataFrame(rows, "v string").repartition(7)
    assert {r.v for r in heavy_hitters(df, "v", 4, 64, 40).collect()} >= {"hot", "warm"}
    assert {r.v for r in heavy_hitters(df, "v", 4, 64, 200).collect()} == {"hot"}
    assert heavy_hitters(df.limit(0), "v", 4, 64).count() == 0
