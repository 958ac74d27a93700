"""Places of rows within their groups, without a window over a group: one sort of the whole table by ranges.

The rows of a group of any size are spread over as many tasks as its rows fill. Each task counts its part of a group;
the counts of earlier tasks give the place at which a part begins. No task sees more than its own range of rows, and the
window that adds up counts has at most one row for each task and group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.llm.common import landed

ROW_BITS = 33  # monotonically_increasing_id holds the partition above them


def ranked(df: DataFrame, group: list[str], order: list[str], groups: bool = False) -> DataFrame:
    """df, a narrow landed table, with place (from 0) and size of its group; nulls sort first.

    order should tell rows apart, else equal ones meet in one task. With groups also group_place and n_groups, the place
    of the group among all groups. Columns place, size, group_place, n_groups and row_at are made here."""
    by = [*group, *order]
    own = landed(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_at", F.monotonically_increasing_id()), "sorted")
    own = own.withColumn("part", F.shiftrightunsigned("row_at", ROW_BITS))
    runs = own.groupBy("part", *group).agg(F.min("row_at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = W.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    of = [f"of_{c}" for c in group]
    runs = runs.select(
        F.col("part").alias("of_part"),
        *[F.col(c).alias(o) for c, o in zip(group, of)],
        "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(whole).alias("size"),
    )
    more = []
    if groups:
        runs = landed(runs, "runs")
        each = ranked(landed(runs.select(*[F.col(o).alias(c) for c, o in zip(group, of)]).distinct(), "groups"), [], group)
        each = each.select(*group, F.col("place").alias("group_place"), F.col("size").alias("n_groups"))
        runs = runs.join(each, [F.col(o).eqNullSafe(F.col(c)) for c, o in zip(group, of)]).drop(*group)
        more = ["group_place", "n_groups"]
    found = own.join(runs, [F.col("part") == F.col("of_part"), *[F.col(c).eqNullSafe(F.col(o)) for c, o in zip(group, of)]])
    place = (F.col("row_at") - F.col("first") + F.col("before")).alias("place")
    return found.select(*df.columns, place, "size", *more)
