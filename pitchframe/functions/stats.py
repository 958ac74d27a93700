"""Rank statistics with averaged ties, exact quantile bins and classification scores, as DataFrame operations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import ratio

BUCKETS = 1000


def average_rank(column: str, by: list[str], descending: bool = False) -> Column:
    """Rank from 1, ties sharing their mean; null for null."""
    key = F.col(column)
    order = (key.desc_nulls_last() if descending else key.asc_nulls_last(),)
    ties = F.count(key).over(W.partitionBy(*by, key))
    return F.when(key.isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(*order)) + (ties - 1) / F.lit(2.0))


def with_rank_percent(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """<metric>_pct: average rank within the group as a percentage of its known values."""
    return df.withColumns({f"{m}_pct": ratio(average_rank(m, by), F.count(m).over(W.partitionBy(*by))) * 100 for m in metrics})


def bucketed(df: DataFrame, column: str, out: str = "bucket", buckets: int = BUCKETS) -> DataFrame:
    """df with the number of the value's range between approximate quantiles: ranges that no single task has to hold together."""
    row = df.agg(F.percentile_approx(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10 * buckets).alias("e")).first()
    splits = [float("-inf"), *sorted(set(row["e"] or [0.0])), float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="skip").transform(df).withColumn(out, F.col(out).cast("int"))


def rank_sums(scored: DataFrame, target: str, score: str, by: list[str]) -> DataFrame:
    """auc by group: the share of pairs in order, ties half.

    Rows are first counted by score, which combines before the shuffle; negatives below a score are those of the lower
    buckets (BUCKETS rows a group) and those below it in its own."""
    counted = scored.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(target)).alias("pos"), F.count_if(~F.col(target)).alias("neg")
    )
    counted = bucketed(counted, "s")
    earlier = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    lower = counted.groupBy(*by, "bucket").agg(F.sum("neg").alias("n")).withColumn("lower", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = W.partitionBy(*by, "bucket").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(lower, [*by, "bucket"])
    won = placed.withColumn("won", F.col("pos") * (F.col("lower") + F.col("inside") + F.col("neg") / 2.0))
    out = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, ratio(F.col("won"), F.col("p") * F.col("n")).alias("auc"))


def binary_scores(scored: DataFrame, target: str, score: str, by: list[str], clip: float | None = None) -> DataFrame:
    """rows, positives, expected, base_rate, log_loss (null with one class), brier and auc, a row for each group."""
    p = F.col(score)
    if clip:
        p = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    y = F.col(target).cast("double")
    safe = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    rows = scored.withColumns({"__p": p, "__y": y, "__l": -(y * F.log(safe) + (1 - y) * F.log(1 - safe)), "__t": F.col(target)})
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("__y").cast("long").alias("positives"),
        F.sum("__p").alias("expected"),
        F.avg("__y").alias("base_rate"),
        F.when((F.min("__y") == 0) & (F.max("__y") == 1), F.avg("__l")).alias("log_loss"),
        F.avg((F.col("__p") - F.col("__y")) ** 2).alias("brier"),
    )
    if not by:
        return _with_one_row(out, rank_sums(rows, "__t", "__p", []))
    areas = rank_sums(rows, "__t", "__p", by)
    return out.join(areas, by, "left")


def _with_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("__k", F.lit(0)).join(b.withColumn("__k", F.lit(0)), "__k", "left").drop("__k")


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Linearly interpolated quantiles of a column, exact at any size.

    Counts by bucket tell where each wanted rank lies; only the values of those buckets are then ranked."""
    own = bucketed(df.select(F.col(column).cast("double").alias("v")).filter("v is not null"), "v")
    counts = {r["bucket"]: r["count"] for r in own.groupBy("bucket").count().collect()}  # BUCKETS rows at most
    n = sum(counts.values())
    if not n:
        return []
    places = [share * (n - 1) for share in shares]
    ranks = sorted({r for h in places for r in (int(h), min(int(h) + 1, n - 1))})
    where, seen, left = [], 0, list(ranks)
    for bucket in sorted(counts):
        while left and left[0] < seen + counts[bucket]:
            where.append((bucket, left[0] - seen, left.pop(0)))
        seen += counts[bucket]
    wanted = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(o).alias("o")) for b, o, _ in where])
    ranked = own.filter(F.col("bucket").isin(sorted({b for b, *_ in where}))).groupBy("bucket", "v").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("before", before)
    hit = F.exists(wanted, lambda w: (w["b"] == F.col("bucket")) & (w["o"] >= F.col("before")) & (w["o"] < F.col("before") + F.col("c")))
    found = ranked.filter(hit).collect()  # a row for each wanted rank at most
    value = {r: next(x["v"] for x in found if x["bucket"] == b and x["before"] <= o < x["before"] + x["c"]) for b, o, r in where}
    return [value[int(h)] + (h - int(h)) * (value[min(int(h) + 1, n - 1)] - value[int(h)]) for h in places]


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct edges of equal-count bins: bins + 1 numbers at most reach the driver."""
    return sorted(set(exact_quantiles(df, column, [i / bins for i in range(bins + 1)])))


def quantile_bin(column: Column, edges: list[float]) -> Column:
    """Number of the bin, right-closed, the first closed on both sides; equal edges make fewer bins."""
    out = F.lit(None).cast("int")
    for i in reversed(range(1, len(edges))):
        out = F.when(column <= edges[i], F.lit(i)).otherwise(out)
    return F.when(column >= edges[0], out) if edges else out


def calibration(df: DataFrame, target: str, score: str, bins: int) -> DataFrame:
    """A row for each quantile bin of the score: rows, mean score, observed rate, edges."""
    edges = quantile_edges(df, score, bins)
    binned = df.withColumn("bin", quantile_bin(F.col(score), edges)).filter("bin is not null")
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(target).cast("double")).alias("observed"),
        F.min(score).alias("least"),
        F.max(score).alias("most"),
    )


def with_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the rank of a known column over the whole table, ties sharing their mean, without a task that holds all rows.

    Equal values are counted first; those of lower ranges (BUCKETS rows) and lower ones of the own range come before."""
    values = bucketed(df.groupBy(F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c")), "__v", "__b")
    earlier = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # over BUCKETS rows at most
    lower = values.groupBy("__b").agg(F.sum("__c").alias("n")).select("__b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__l"))
    inside = F.coalesce(F.sum("__c").over(W.partitionBy("__b").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = values.withColumn("__i", inside).join(lower, "__b").select("__v", (F.col("__l") + F.col("__i") + (F.col("__c") + 1) / F.lit(2.0)).alias(out))
    return df.withColumn("__v", F.col(column).cast("double")).join(ranks, "__v").drop("__v")


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """n, pearson, spearman (average ranks), mean difference, MAE and RMSE of two columns, where both are known."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if by:
        both = both.withColumns({"__ra": average_rank(a, by), "__rb": average_rank(b, by)})
    else:
        both = with_average_rank(with_average_rank(both, a, "__ra"), b, "__rb")
    both = both.withColumn("__d", F.col(a) - F.col(b))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(a, b).alias("pearson"),
        F.corr("__ra", "__rb").alias("spearman"),
        F.avg("__d").alias("mean_difference"),
        F.avg(F.abs("__d")).alias("mae"),
        F.sqrt(F.avg(F.col("__d") ** 2)).alias("rmse"),
    )
