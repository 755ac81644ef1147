"""How entries are cited: order of years in a group, keys without an entry, entries without a citation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_of_order(groups: DataFrame, years: DataFrame) -> DataFrame:
    """Groups (group_id, keys) whose known years fall; groups with an unknown year are left out.  ``years`` is (key, year)."""
    one = years.groupBy("key").agg(F.max("year").alias("year"))
    each = groups.select("group_id", F.posexplode("keys").alias("pos", "key")).join(one, "key", "left")
    lists = each.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "year"))).alias("l"), F.count_if(F.col("year").isNull()).alias("unknown"))
    ys = F.transform("l", lambda x: x["year"])
    return lists.filter("unknown = 0").select("group_id", ys.alias("years")).filter(F.col("years") != F.array_sort("years"))


def dropped(cited: DataFrame, entries: DataFrame) -> DataFrame:
    return cited.select("key").distinct().join(entries.select("key").distinct(), "key", "left_anti")


def uncited(entries: DataFrame, cited: DataFrame) -> DataFrame:
    return entries.join(cited.select("key").distinct(), "key", "left_anti")
