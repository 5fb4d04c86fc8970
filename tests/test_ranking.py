from pyspark.sql import functions as F

from leafsieve.operators.ranking import with_position


def test_columns_of_any_name_stay(spark):
    df = spark.range(50).withColumns({c: F.lit("own") for c in ("__at", "__part", "__before", "at", "part_", "BEFORE", "n")}).repartition(7)
    out = with_position(df.orderBy(F.desc("id")), "place")
    assert out.columns == [*df.columns, "place"]
    assert {(r.id, r.place, r["__at"], r["n"]) for r in out.collect()} == {(k, 49 - k, "own", "own") for k in range(50)}
