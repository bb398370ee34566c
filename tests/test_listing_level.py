"""The listing level reads only what is asked of it, and a tie gives one row's values."""

from pyspark.sql import functions as F

from lodgelens.plans import features as FE


def _panel(spark):
    rows = [(1, 5, 10.0, 2.0, 1.0, "a", 1), (1, 4, 20.0, 3.0, 1.0, "b", None), (1, 4, 20.0, 3.0, 1.0, "b", None), (2, 6, 7.0, 1.0, 1.0, None, 3)]
    return spark.createDataFrame(rows, "id long, month int, price_numeric double, log_price double, seasonal_index double, kind string, beds int")


def test_values_of_the_earliest_month(spark):
    got = sorted(tuple(r) for r in FE.listing_level(_panel(spark)).collect())
    assert got == [(1, 50.0 / 3, 8.0 / 3, "b", None), (2, 7.0, 1.0, None, 3)]


def test_columns_not_asked_for_are_not_read(spark):
    level = FE.listing_level(_panel(spark)).select("id", "beds").agg(F.sum("beds"))
    assert level._jdf.queryExecution().optimizedPlan().toString().count("kind#") == 1  # the rows' own columns


def test_ties_give_one_row(spark):
    panel = spark.range(400).select((F.col("id") % 20).alias("id"), F.lit(4).alias("month"), F.lit(1.0).alias("price_numeric"), F.lit(1.0).alias("log_price"),
                                    F.lit(1.0).alias("seasonal_index"), F.col("id").alias("a"), (F.col("id") * 7).alias("b")).repartition(7)
    rows = FE.listing_level(panel).collect()
    assert len(rows) == 20 and all(r["b"] == 7 * r["a"] for r in rows)
