"""Requests that ask the same are answered together."""

from pyspark.sql import functions as F

from playbill.operators import request_join
from tests.test_request_join import catalogue, requests


def test_those_who_ask_the_same_are_scored_once(spark):
    kinds = request_join.request_table(spark, requests(9)).drop("request_id").distinct()
    n = kinds.count()
    many = kinds.crossJoin(spark.range(20)).withColumn("request_id", F.when(F.col("id") > 0, F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))).drop("id")
    again = many.filter("request_id IS NOT NULL").limit(3)  # an id may occur more than once, or not be known
    many = many.unionByName(again).localCheckpoint()
    asked, who = request_join.shared(many)
    assert asked.count() == n and who.count() == 20 * n + 3
    df = catalogue(spark, 80)
    key = lambda x: sorted(str(tuple(r)) for r in x.groupBy("request_id").agg(F.count("*"), F.max("score"), F.sum("score"), F.sum("distance_km")).collect())
    each = request_join.scored(df, many)
    together = who.join(request_join.scored(df, asked).withColumnRenamed("request_id", "asked_id"), "asked_id")
    assert key(together) == key(each) != []
