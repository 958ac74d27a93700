"""Efforts: runs of samples above a threshold, merged over short dips, with their shares and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.operators.tracking import EPS, KMH, SEGMENT, TRACK, TrackingConfig


def effort_kinds(
    frame: DataFrame, kinds: dict[str, Column], dt: float, dips: tuple[float, ...] = (0.0,), shares: dict[str, Column] | None = None,
    peak: Column | None = None, keys: list[str] = TRACK, segment: str = "segment_id", order: list[str] = ["timestamp"],
) -> DataFrame:
    """A row for each kind (a mask), dip and effort: first and last moment, samples, seconds above, peak, shares of flags.

    Gaps and islands of all masks in one order of the segment: runs of equal mask first, then, on the few rows of runs,
    chains of runs across one short dip. The frame is read and sorted once, however many kinds and dips there are."""
    w = W.partitionBy(*keys, segment).orderBy(*order)
    number = {k: i for i, k in enumerate(kinds)}
    rows = frame.withColumns(
        {
            **{f"__s_{k}": F.coalesce(v, F.lit(False)).cast("int") for k, v in (shares or {}).items()},
            **{f"__on{i}": F.coalesce(kinds[k], F.lit(False)) for k, i in number.items()},
            "__peak": peak if peak is not None else F.lit(None).cast("double"),
        }
    )
    rows = rows.withColumns({f"__turn{i}": F.coalesce(F.col(f"__on{i}") != F.lag(f"__on{i}").over(w), F.lit(True)).cast("int") for i in number.values()})
    rows = rows.withColumns({f"__run{i}": F.sum(f"__turn{i}").over(w.rowsBetween(W.unboundedPreceding, 0)) for i in number.values()})
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"__on{i}").alias("on"), F.col(f"__run{i}").alias("run")) for k, i in number.items()])
    at = F.col(order[0]).alias("__time")
    rows = rows.select(*keys, segment, at, "__peak", *[f"__s_{k}" for k in shares or {}], F.explode(each).alias("__e"))
    if max(dips) <= 0:
        rows = rows.filter("__e.on")  # no dip is merged, so what lies between efforts isn't needed
    runs = rows.groupBy(*keys, segment, F.col("__e.kind").alias("kind"), F.col("__e.run").alias("__run"), F.col("__e.on").alias("__on")).agg(
        F.min("__time").alias("__first"), F.max("__time").alias("__last"), F.count(F.lit(1)).alias("__len"), F.max("__peak").alias("__peak"),
        *[F.sum(f"__s_{k}").alias(f"__s_{k}") for k in shares or {}],
    )
    runs = runs.withColumn("dip", F.explode(F.array(*[F.lit(float(d)) for d in dips])))
    chain = W.partitionBy(*keys, segment, "kind", "dip").orderBy("__run")
    # a run below the threshold lies between two above it unless it is the first or the last
    inner = F.lag("__run").over(chain).isNotNull() & F.lead("__run").over(chain).isNotNull()
    runs = runs.withColumn("__in", F.col("__on") | (inner & (F.col("dip") > 0) & (F.col("__len") * dt <= F.col("dip") + EPS)))
    # runs that nothing lies between (dips were left out) are apart: their numbers aren't neighbours
    before = F.lag("__in").over(chain) & (F.lag("__run").over(chain) == F.col("__run") - 1)
    runs = runs.withColumn("__open", (F.col("__in") & ~F.coalesce(before, F.lit(False))).cast("int"))
    runs = runs.withColumn("effort", F.sum("__open").over(chain.rowsBetween(W.unboundedPreceding, 0))).filter("__in")
    return runs.groupBy(*keys, segment, "kind", "dip", "effort").agg(
        F.min("__first").alias("first"), F.max("__last").alias("last"), F.sum("__len").alias("samples"),
        (F.coalesce(F.sum(F.when(F.col("__on"), F.col("__len"))), F.lit(0)) * dt).alias("above_seconds"), F.max("__peak").alias("peak"),
        *[(F.sum(f"__s_{k}") / F.sum("__len")).alias(f"{k}_share") for k in shares or {}],
    )


def effort_seconds(dt: float, rule: str) -> Column:
    """What an effort's least duration is held against: its span, or the samples above the threshold."""
    return (F.col("samples") - 1) * dt if rule == "span" else F.col("above_seconds")


def efforts(
    frame: DataFrame, mask: Column, dt: float, least: float = 0.0, dip: float = 0.0, rule: str = "samples",
    shares: dict[str, Column] | None = None, peak: Column | None = None, keys: list[str] = TRACK, segment: str = "segment_id",
    order: list[str] = ["timestamp"],
) -> DataFrame:
    """A row for each effort: first and last moment, seconds above the threshold, shares of flags over its whole span."""
    found = effort_kinds(frame, {"": mask}, dt, (dip,), shares, peak, keys, segment, order).drop("kind", "dip")
    return found.filter(effort_seconds(dt, rule) >= least - EPS)


def counted(frame: DataFrame, mask: Column, config: TrackingConfig, live: dict[str, Column], name: str, least: float | None = None) -> DataFrame:
    """By match and player: <name><suffix>, the efforts with enough of each flag of live (suffix to flag)."""
    found = efforts(
        frame, mask, config.dt, config.effort_min_seconds if least is None else least, config.effort_dip_seconds, config.effort_rule,
        shares={f"live{k}": v for k, v in live.items()},
    )
    enough = lambda k: F.col(f"live{k}_share") >= config.effort_live_share - EPS
    return found.groupBy("match_id", "player_id").agg(*[F.count_if(enough(k)).alias(f"{name}{k}") for k in live])


def peaks(frame: DataFrame, config: TrackingConfig, speed: str = "raw_speed_mps", least: float = 0.0) -> DataFrame:
    """The peak of every effort above the entry speed of the percentile."""
    return efforts(frame, F.col(speed) > config.psv_min_kmh * KMH, config.dt, least, config.effort_dip_seconds, config.effort_rule, peak=F.col(speed))


def peak_percentile(frame: DataFrame, config: TrackingConfig, speed: str = "raw_speed_mps", least: float = 0.0, name: str = "psv99_kmh") -> DataFrame:
    """By match and player: the interpolated percentile of effort peaks up to the plausible limit, in km/h."""
    found = peaks(frame, config, speed, least).filter(F.col("peak") <= config.psv_max_kmh * KMH)
    return found.groupBy("match_id", "player_id").agg((F.percentile("peak", config.psv_percentile / 100) / KMH).alias(name))


def frame_percentile(frame: DataFrame, config: TrackingConfig, by: list[str], speed: str = "raw_speed_mps", weight: str = "dt", name: str = "psv99_frame_kmh") -> DataFrame:
    """The duration-weighted percentile of samples: the first speed at which the running weight meets its share."""
    kept = frame.filter((F.col(weight) > 0) & (F.col(speed) > config.psv_min_kmh * KMH) & (F.col(speed) <= config.psv_max_kmh * KMH))
    summed = kept.groupBy(*by, F.col(speed).alias("s")).agg(F.sum(weight).alias("w"))  # combines equal speeds first
    run = F.sum("w").over(W.partitionBy(*by).orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("w").over(W.partitionBy(*by))
    met = summed.withColumns({"run": run, "whole": whole}).filter(F.col("run") >= F.col("whole") * (config.psv_percentile / 100) - 1e-12)
    return met.groupBy(*by).agg((F.min("s") / KMH).alias(name))


def sensitivity(frame: DataFrame, mask: Column, config: TrackingConfig, dips: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3)) -> DataFrame:
    """Numbers of efforts under both duration rules and several dips, all from one pass over the samples."""
    found = effort_kinds(frame, {"": mask}, config.dt, dips)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), effort_seconds(config.dt, r).alias("seconds")) for r in ("samples", "span")])
    found = found.withColumn("__r", F.explode(rules)).filter(F.col("__r.seconds") >= config.effort_min_seconds - EPS)
    return found.groupBy("match_id", "player_id", F.col("__r.rule").alias("rule"), F.col("dip").alias("dip_seconds")).agg(F.count(F.lit(1)).alias("efforts"))
