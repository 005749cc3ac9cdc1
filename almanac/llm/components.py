"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour and is two aggregations and joins
on distributed tables, written to the shared folder; the number of rounds grows with the
logarithm of the longest chain. Both are written on their own: their plans stay small in the driver. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Written


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    least = _both(links).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # no more rows than links; the small star leaves out repeated ones
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # the smallest neighbour's own row would link it with itself: it holds the link of "u" instead
    near = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return near.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, of every node with a link (``u``, ``v``).

    Links of a node to itself and repeated links change nothing; without links there are no rows.
    """
    stars = Written(links.select("u", "v").where("u <> v").distinct(), "links")
    before = _state(stars.frame)
    while before[0]:
        # written, as the small star reads it twice and the plan of both would be planned as one
        large = Written(_large_star(stars.frame), "large")
        stars.drop()
        stars = Written(_small_star(large.frame), "stars")
        large.drop()
        after = _state(stars.frame)
        if after == before:
            break
        before = after
    rooted = stars.frame.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root")).distinct()
