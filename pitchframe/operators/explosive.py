"""Explosive efforts: times from walking to high speeds after an acceleration or a sharp turn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import require
from pitchframe.operators.tracking import EPS, KMH, SEGMENT, TRACK, TrackingConfig


@dataclass(frozen=True)
class ExplosiveConfig:
    walk_kmh: float = 9.0
    hsr_kmh: float = 20.0
    sprint_kmh: float = 25.0
    acceleration_mps2: float = 3.0
    acceleration_seconds: float = 0.7
    lookback_seconds: float = 3.0
    most_seconds: float = 5.0
    turn_degrees: float = 60.0
    heading_seconds: float = 0.5
    cooldown_seconds: float = 1.0
    live_share: float = 0.5


def mean_angle(angle: Column, w) -> Column:
    """The mean direction over a window."""
    return F.atan2(F.avg(F.sin(angle)).over(w), F.avg(F.cos(angle)).over(w))


def angle_between(a: Column, b: Column) -> Column:
    return F.degrees(F.abs(F.atan2(F.sin(a - b), F.cos(a - b))))


def crossing_time(threshold: float) -> Column:
    """The interpolated moment of an upward crossing between a track's row and the row before; null where there is none."""
    w = W.partitionBy(*TRACK).orderBy("timestamp")
    before, t0 = F.lag("speed_mps").over(w), F.lag("timestamp").over(w)
    share = (threshold - before) / F.greatest(F.col("speed_mps") - before, F.lit(1e-12))
    return F.when((before < threshold) & (F.col("speed_mps") >= threshold), t0 + share * (F.col("timestamp") - t0))


def next_of(what: Column, keys: list[str] = TRACK, skip: int = 1) -> Column:
    """The nearest value that isn't null at least `skip` rows further on. Rows are walked backwards, so each is read once."""
    return F.last(what, ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -skip))


def with_sharp(frame: DataFrame, config: ExplosiveConfig, dt: float) -> DataFrame:
    """Rows (numbered by __at) with angle, the turn between the headings before and after, and __sharp, whether it counts."""
    n = max(2, round(config.heading_seconds / dt))
    w = W.partitionBy(*TRACK).orderBy("timestamp")
    pre, post = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    rows = frame.withColumns({"__h": F.atan2("vy", "vx"), "__ok": F.coalesce(F.col("valid_interval") & (F.col("speed_mps") >= config.walk_kmh * KMH), F.lit(False))})
    good = lambda side: (F.count(F.lit(1)).over(side) == n) & (F.min("__ok").over(side) == F.lit(True))
    same = F.lag("segment_id", n).over(w) == F.lead("segment_id", n).over(w)
    rows = rows.withColumns({"__good": good(pre) & good(post) & same, "angle": angle_between(mean_angle(F.col("__h"), pre), mean_angle(F.col("__h"), post))})
    return rows.withColumn("__sharp", F.coalesce(F.col("__good") & (F.col("angle") >= config.turn_degrees), F.lit(False))).drop("__h", "__ok", "__good")


def with_best(rows: DataFrame, config: ExplosiveConfig, dt: float) -> DataFrame:
    """__best: whether a sharp row is the sharpest of its turn. Rows that aren't sharp may be left out before."""
    w = W.partitionBy(*TRACK).orderBy("__at")
    before = F.last(F.when(F.col("__sharp"), F.col("__at")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    cool = max(1, round(config.cooldown_seconds / dt))
    rows = rows.withColumn("__fresh", (F.col("__sharp") & F.coalesce(F.col("__at") - before >= cool, F.lit(True))).cast("int"))
    rows = rows.withColumn("__turn", F.sum("__fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = F.row_number().over(W.partitionBy(*TRACK, "__turn").orderBy(F.desc("__sharp"), F.desc("angle"), "__at"))
    return rows.withColumn("__best", F.col("__sharp") & (best == 1)).drop("__fresh", "__turn")


def turns(frame: DataFrame, config: ExplosiveConfig, dt: float) -> DataFrame:
    """The sharpest moment of each sharp turn: track, at, angle."""
    rows = frame.withColumn("__at", F.row_number().over(W.partitionBy(*TRACK).orderBy("timestamp")))
    found = with_best(with_sharp(rows, config, dt).filter("__sharp"), config, dt).filter("__best")
    return found.select(*TRACK, F.col("__at").alias("at"), "angle", F.col("timestamp").alias("source_timestamp"), F.col("segment_id").alias("source_segment"))


def with_begun(frame: DataFrame, mask: Column, dt: float, least: float, rule: str) -> DataFrame:
    """__begun: whether an effort of at least that long begins at a row. An effort is a run of the mask within a segment."""
    w = W.partitionBy(*SEGMENT).orderBy("timestamp")
    rows = frame.withColumn("__on", F.coalesce(mask, F.lit(False)))
    rows = rows.withColumn("__first", F.coalesce(F.col("__on") != F.lag("__on").over(w), F.lit(True)))
    rows = rows.withColumn("__run", F.sum(F.col("__first").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    samples = F.count(F.lit(1)).over(W.partitionBy(*SEGMENT, "__run"))
    lasting = (samples - 1 if rule == "span" else samples) * dt >= least - EPS
    return rows.withColumn("__begun", F.col("__on") & F.col("__first") & lasting).drop("__on", "__first", "__run")


def explosive_efforts(frame: DataFrame, physical: TrackingConfig = TrackingConfig(), config: ExplosiveConfig = ExplosiveConfig()) -> DataFrame:
    """family, target, seconds from 9 km/h to the target speed, live share; a row for each effort and target.

    Every row learns by windows of its track which crossings come next, so starts need no join: the frame is read and
    dealt by track once."""
    require(frame, [*TRACK, "timestamp", "segment_id", "speed_mps", "acceleration_mps2", "is_bip", "valid_interval", "vx", "vy"])
    w = W.partitionBy(*TRACK).orderBy("timestamp")
    walk, speed = config.walk_kmh * KMH, F.col("speed_mps")
    targets = {"hsr": config.hsr_kmh * KMH, "sprint": config.sprint_kmh * KMH}
    rows = frame.select(*TRACK, "timestamp", "segment_id", "speed_mps", "acceleration_mps2", "is_bip", "valid_interval", "vx", "vy")
    rows = rows.withColumns({"__at": F.row_number().over(w), "__bip": F.col("is_bip").cast("int"), **{f"__{k}": crossing_time(v) for k, v in {"walk": walk, **targets}.items()}})
    rows = rows.withColumn("__live", F.sum("__bip").over(w.rowsBetween(W.unboundedPreceding, 0)))
    hit = lambda k: F.when(F.col(f"__{k}").isNotNull(), F.struct(F.col("__at").alias("at"), F.col(f"__{k}").alias("time"), F.col("segment_id").alias("segment"), F.col("__live").alias("live")))
    rows = rows.withColumns({f"__next_{k}": next_of(hit(k)) for k in targets})
    # where an effort's time begins: a row, its moment, live rows before it, and the crossings behind it
    place = lambda time: F.struct(
        F.col("__at").alias("at"), time.alias("time"), F.col("segment_id").alias("segment"), (F.col("__live") - F.col("__bip")).alias("live"),
        *[F.col(f"__next_{k}").alias(k) for k in targets],
    )
    rows = rows.withColumn("__onset", next_of(F.when(F.col("__walk").isNotNull(), place(F.col("__walk")))))
    # accelerations: the last slow sample within the look-back of the same segment, then the crossing of walking speed
    slow = W.partitionBy(*SEGMENT).orderBy(F.round(F.col("timestamp") * 1e6).cast("long")).rangeBetween(-round(config.lookback_seconds * 1e6), 0)
    rows = rows.withColumn("__slow", F.last(F.when(speed < walk, F.struct(F.col("__onset").alias("onset"))), ignorenulls=True).over(slow))
    rows = with_begun(rows, F.col("valid_interval") & (F.col("acceleration_mps2") > config.acceleration_mps2), physical.dt, config.acceleration_seconds, physical.effort_rule)
    # turns: the first sample at walking speed or faster from the turn on, in its segment
    rows = rows.withColumn("__fast", next_of(F.when(speed >= walk, place(F.col("timestamp"))), SEGMENT, 0))
    rows = with_best(with_sharp(rows, config, physical.dt).filter("__begun or __sharp"), config, physical.dt)
    start = lambda family, at, angle: F.struct(F.lit(family).alias("family"), at.alias("from"), angle.alias("angle"))
    starts = F.array(
        F.when(F.col("__begun"), start("time_to_speed", F.col("__slow.onset"), F.lit(None).cast("double"))),
        F.when(F.col("__best"), start("post_cod_time_to_speed", F.col("__fast"), F.col("angle"))),
    )
    out = rows.select(*TRACK, F.col("timestamp").alias("source_timestamp"), F.explode(F.filter(starts, lambda s: s["from"].isNotNull())).alias("s"))
    ends = F.array(*[F.struct(F.lit(k).alias("target"), F.col(f"s.from.{k}").alias("to")) for k in targets])
    out = out.withColumn("e", F.explode(ends)).withColumn("seconds", F.col("e.to.time") - F.col("s.from.time"))
    out = out.filter((F.col("e.to.segment") == F.col("s.from.segment")) & (F.col("seconds") <= config.most_seconds + EPS))
    share = (F.col("e.to.live") - F.col("s.from.live")) / (F.col("e.to.at") - F.col("s.from.at") + 1)
    return out.select(
        *TRACK, "s.family", "e.target", "seconds", F.col("s.from.time").alias("onset_timestamp"), F.col("e.to.time").alias("target_timestamp"), "source_timestamp",
        F.col("s.angle").alias("cod_angle_degrees"), share.alias("bip_share"), (share >= config.live_share).alias("bip_attributed"),
    )
