"""Times in nanoseconds at the end of a second, where a double would round up."""

from tessera.functions import decimals


def test_last_nanosecond_of_a_second(spark):
    last = 1_704_067_199_999_999_999
    given = spark.createDataFrame([(last,), (-1,), (0,)], "n long")
    texts = [r.t for r in given.select(decimals.rfc3339_of_nanos(given.n).alias("t")).collect()]
    assert texts == ["2023-12-31T23:59:59.999999999Z", "1969-12-31T23:59:59.999999999Z", "1970-01-01T00:00:00.000000000Z"]
    micros = [r.t for r in given.selectExpr("n").select(decimals.timestamp_of_nanos(given.n).cast("string").alias("t")).collect()]
    assert micros[0] == "2023-12-31 23:59:59.999999" and micros[1] == "1969-12-31 23:59:59.999999"
