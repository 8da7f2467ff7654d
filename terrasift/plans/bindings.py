"""The operators' roles bound to the provided tables.

There is no imagery among them, so these are structural stand-ins: a nation is a
site, an order's half-month a period, an embedding's first six components a
spectrum, an hour-by-day lattice of events a raster. Ratios are made from exact
integer sums, so that they don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions.periods import ordinal_of_date
from terrasift.operators.spectral import BANDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six places, halves to even, no negative zero."""
    return F.bround(c.cast("double"), 6) + F.lit(0.0)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, ord, n, ndbi, swir, ndvi, valid_frac."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("uid"), ordinal_of_date(F.col("o_orderdate")).alias("ord"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    n = F.count("*")
    return d.groupBy("uid", "ord").agg(
        n.alias("n"),
        (F.sum(F.floor("o_totalprice").cast("long")).cast("double") / n / 499979).alias("ndbi"),
        (F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")) / n).alias("swir"),
        (F.count_if(F.col("o_orderstatus") == "F") / n).alias("ndvi"),
        (F.count_if(F.col("o_totalprice") > 20000) / n).alias("valid_frac"),
    )


SERIES = """series AS (
  SELECT c_nationkey AS uid, CAST(year(o_orderdate) * 24 + (month(o_orderdate) - 1) * 2 + CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS INTEGER) AS ord,
    count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) / count(*) / 499979 AS ndbi,
    CAST(count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) / count(*) AS swir,
    CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS ndvi,
    CAST(count(*) FILTER (o_totalprice > 20000) AS DOUBLE) / count(*) AS valid_frac
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""


def anchors(s: DataFrame) -> DataFrame:
    """A start for each site, and whether it is a positive."""
    return s.select("uid").distinct().select("uid", (F.lit(1998 * 24) + F.col("uid") % 10).cast("int").alias("anchor"), (F.col("uid") % 2 == 0).alias("is_positive"))


ANCHORS = "anchors AS (SELECT DISTINCT uid, CAST(1998 * 24 + uid % 10 AS INTEGER) AS anchor, uid % 2 = 0 AS is_positive FROM series)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid (label), pix, six bands mapped from the embedding into reflectances."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("uid"), F.col("vec_id").alias("pix"), *[(F.col("embedding")[i].cast("double") * 0.5 + 0.3).alias(b) for i, b in enumerate(BANDS)])


PIXELS = "pixels AS (SELECT label AS uid, vec_id AS pix, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 0.5 + 0.3 AS {b}" for i, b in enumerate(BANDS)) + " FROM embeddings)"


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid (event type), y (hour), x (day): cells with more events than the mean cell of their type."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("uid"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).count()
    own = Window.partitionBy("uid")
    busy = e.withColumn("cells", F.count("*").over(own)).withColumn("total", F.sum("count").over(own))
    return busy.where(F.col("count") * F.col("cells") > F.col("total")).select("uid", "y", "x")


LATTICE = """cells AS (
  SELECT uid, y, x FROM (SELECT event_type AS uid, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS x, count(*) AS n FROM events GROUP BY 1, 2, 3)
  QUALIFY n * count(*) OVER (PARTITION BY uid) > sum(n) OVER (PARTITION BY uid)
)"""
