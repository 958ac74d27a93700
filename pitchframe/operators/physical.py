"""Player-match volumes from kinematics, phases of possession, exposure rates, populations, profiles and league tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import has, number, number_or_null, ratio, require
from pitchframe.functions.stats import with_rank_percent
from pitchframe.operators.efforts import effort_kinds, effort_seconds, frame_percentile
from pitchframe.operators.tracking import EPS, KMH, TRACK, TrackingConfig

BAND_EPS = 1e-4
# Volumes and the exposure by which each is divided.
VOLUMES = [
    "total_distance_m", "walking_jogging_distance_m", "running_distance_m", "hsr_distance_m", "sprint_distance_m",
    "high_intensity_distance_m", "running_count", "hsr_count", "sprint_count", "high_intensity_count",
    "high_acceleration_count", "high_deceleration_count",
]
# Names of volumes by phase.
PHASE_VOLUMES = ["distance_{}_m", "high_intensity_distance_{}_m", "sprint_count_{}", "high_intensity_count_{}"]
# Names of a profile's measures.
PROFILE = [
    ("bip_minutes", 60.0, "_p60_bip", ["total_distance_m", "running_distance_m", "hsr_distance_m", "sprint_distance_m",
                                       "high_intensity_distance_m", "sprint_count", "high_intensity_count",
                                       "high_acceleration_count", "high_deceleration_count"]),
    ("tip_minutes", 30.0, "_p30_tip", ["distance_tip_m", "high_intensity_distance_tip_m", "sprint_count_tip"]),
    ("otip_minutes", 30.0, "_p30_otip", ["distance_otip_m", "high_intensity_distance_otip_m", "sprint_count_otip"]),
]
PEAKS = ["psv99_kmh", "max_speed_kmh"]
# Labels of goalkeepers, and of the position groups, without separators.
GOALKEEPERS = ["gk", "goalkeeper", "goalie", "keeper", "골키퍼"]
NO_POSITION = ["sub", "substitute", "unused", "bench", "na", "none", "unknown"]
POSITIONS = {
    "Goalkeeper": GOALKEEPERS,
    "Central Defender": ["cb", "lcb", "rcb", "cd", "centraldefender", "centreback", "centerback", "defender", "df"],
    "Full Back": ["lb", "rb", "lwb", "rwb", "wb", "fb", "fullback", "wingback"],
    "Midfield": ["dm", "cdm", "cm", "cam", "am", "mf", "midfield", "midfielder", "centralmidfield", "defensivemidfield",
                 "attackingmidfield", "lcm", "rcm", "ldm", "rdm", "lam", "ram"],
    "Winger": ["lw", "rw", "lm", "rm", "wm", "winger", "leftwing", "rightwing", "wideattacker", "wideforward", "lwf", "rwf",
               "wf", "lwm", "rwm", "widemidfield"],
    "Forward": ["st", "cf", "fw", "f", "ss", "forward", "striker", "centreforward", "centerforward"],
}
# Parts of a position's name and their groups.
POSITION_PARTS = [
    ("goal.*keep", "Goalkeeper"), ("wing back|full back", "Full Back"), ("wing|wide midfield", "Winger"), ("midfield", "Midfield"),
    ("forward|striker", "Forward"), ("back|defender", "Central Defender"),
]


def position_group(label: Column) -> Column:
    """One of six groups by a provider's label, by parts of it, else the label itself; null for the bench."""
    own = F.trim(label.cast("string"))
    key = F.regexp_replace(F.lower(own), "[_\\-/]", " ")
    compact = F.regexp_replace(key, r"\s+", "")
    out = own
    for pattern, group in reversed(POSITION_PARTS):
        out = F.when(key.rlike(pattern), group).otherwise(out)
    for group, names in reversed(POSITIONS.items()):
        out = F.when(compact.isin(names), group).otherwise(out)
    return F.when(compact.isin(NO_POSITION), F.lit(None)).otherwise(out)


def resolved_group(group: Column, role: Column) -> Column:
    """A goalkeeper by either field; else the group, else the role; 'Other' says nothing."""
    a, b = (F.nullif(position_group(c), F.lit("Other")) for c in (group, role))
    return F.when((a == "Goalkeeper") | (b == "Goalkeeper"), "Goalkeeper").otherwise(F.coalesce(a, b))


def speed_bands(speed: Column, config: TrackingConfig) -> dict[str, Column]:
    """Flags of the bands; null speeds are in none."""
    run, hsr, sprint = (v * KMH for v in (config.running_kmh, config.hsr_kmh, config.sprint_kmh))
    bands = {
        "low": speed < run - EPS,
        "running": (speed >= run - BAND_EPS) & (speed < hsr - BAND_EPS),
        "hsr": (speed >= hsr - BAND_EPS) & (speed <= sprint + BAND_EPS),
        "sprint": speed > sprint + BAND_EPS,
        "high_intensity": speed > hsr + EPS,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in bands.items()}


def with_phases(frame: DataFrame) -> DataFrame:
    """tip and otip: live play in which this team, or the other, has the ball, by numeric ids."""
    owner, team = number_or_null(frame, "ball_owning_team_id"), number_or_null(frame, "team_id")
    side = lambda same: F.coalesce(F.col("is_bip") & same, F.lit(False))
    return frame.withColumns({"tip": side(owner == team), "otip": side(owner.isNotNull() & ((owner != team) | team.isNull()))})


def player_matches(frame: DataFrame, config: TrackingConfig = TrackingConfig()) -> DataFrame:
    """A row a player and match: exposure, distances by band and phase, efforts, peaks and rates.

    Volumes come from one aggregation, all kinds of efforts and their peaks from one more, both partitioned by track."""
    frame = with_phases(frame)
    bands = speed_bands(F.col("speed_mps"), config)
    rows = frame.withColumns({f"__{k}": v for k, v in bands.items()})
    on, valid, live = (lambda k: F.col(f"__{k}")), F.col("valid_interval"), F.col("is_bip")
    sums = lambda c, *flags: F.coalesce(F.sum(F.when(reduce(lambda a, b: a & b, flags), F.col(c))), F.lit(0.0))
    step, dt = "step_distance_m", "dt"
    first = lambda c: F.first(F.col(c), ignorenulls=True) if has(rows, c) else F.first(F.lit(None).cast("string"))
    base = rows.groupBy("match_id", "player_id").agg(
        *[first(c).alias(c) for c in ("team_id", "position", "position_group", "player_name")],
        *[F.max(number_or_null(rows, c)).alias(c) for c in ("provider_playing_time_ms", "appearance_start_seconds", "appearance_end_seconds")],
        F.count(F.lit(1)).alias("sample_count"),
        F.countDistinct("period_id", "segment_id").alias("segment_count"),
        F.countDistinct("period_id").alias("period_count"),
        F.coalesce(F.sum(dt), F.lit(0.0)).alias("observed_seconds"),
        sums(dt, valid).alias("valid_seconds"),
        sums(dt, valid, live).alias("bip_seconds"),
        sums(dt, F.col("tip")).alias("tip_seconds"),
        sums(dt, F.col("otip")).alias("otip_seconds"),
        F.count_if("capped_speed").alias("capped_speed_count"),
        F.count_if("capped_acceleration").alias("capped_acceleration_count"),
        F.count_if(~valid).alias("invalid_interval_count"),
        sums(step, valid).alias("total_distance_all_m"),
        sums(step, valid, live).alias("total_distance_m"),
        sums(step, valid, live, on("low")).alias("walking_jogging_distance_m"),
        *[sums(step, valid, live, on(k)).alias(f"{k}_distance_m") for k in ("running", "hsr", "sprint", "high_intensity")],
        *[sums(step, valid, F.col(p)).alias(f"distance_{p}_m") for p in ("tip", "otip")],
        *[sums(step, valid, F.col(p), on("high_intensity")).alias(f"high_intensity_distance_{p}_m") for p in ("tip", "otip")],
        (F.max("speed_mps") / KMH).alias("max_speed_kmh"),
    )
    lives = {"": F.col("is_bip"), "_tip": F.col("tip"), "_otip": F.col("otip")}
    accel, hard = F.col("acceleration_mps2"), config.high_acceleration_mps2
    masks = {
        "running": on("running") & valid, "hsr": on("hsr") & valid, "sprint": on("sprint") & valid, "high_acceleration": accel > hard,
        "high_deceleration": accel < -hard, "peak": F.col("raw_speed_mps") > config.psv_min_kmh * KMH,
    }
    found = effort_kinds(rows, masks, config.dt, (config.effort_dip_seconds,), {f"live{k}": v for k, v in lives.items()}, F.col("raw_speed_mps"))
    lasting = lambda kind, least: (F.col("kind") == kind) & (effort_seconds(config.dt, config.effort_rule) >= least - EPS)
    enough = lambda k: F.col(f"live{k}_share") >= config.effort_live_share - EPS
    peak = lambda least: F.percentile(F.when(lasting("peak", least) & (F.col("peak") <= config.psv_max_kmh * KMH), F.col("peak")), config.psv_percentile / 100) / KMH
    counted = [("running", "", config.effort_min_seconds), *[(b, k, config.effort_min_seconds) for b in ("hsr", "sprint") for k in lives]]
    counted += [(k, "", config.high_acceleration_min_seconds) for k in ("high_acceleration", "high_deceleration")]
    kinds = found.groupBy("match_id", "player_id").agg(
        *[F.count_if(lasting(kind, least) & enough(k)).alias(f"{kind}_count{k}") for kind, k, least in counted],
        peak(0.0).alias("psv99_kmh"), peak(0.7).alias("psv99_activity_min07_kmh"),
    )
    out = base.join(kinds, ["match_id", "player_id"], "left").join(frame_percentile(rows, config, ["match_id", "player_id"]), ["match_id", "player_id"], "left")
    counts = [c for c in out.columns if "_count" in c and c not in base.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    out = out.withColumns({f"high_intensity_count{k}": F.col(f"hsr_count{k}") + F.col(f"sprint_count{k}") for k in lives})
    return with_rates(with_played_time(out))


def with_played_time(rows: DataFrame) -> DataFrame:
    """Seconds played by the provider, else by the appearance, else as observed; gaps, minutes and coverage."""
    ms, a, b = (F.col(c) for c in ("provider_playing_time_ms", "appearance_start_seconds", "appearance_end_seconds"))
    source = F.when(ms > 0, "provider_playing_time").when(b > a, "appearance_interval").otherwise("observed_tracking")
    out = rows.withColumn("played_time_source", source)
    kind = F.col("played_time_source")
    out = out.withColumn("played_seconds", F.when(kind == "provider_playing_time", ms / 1000).when(kind == "appearance_interval", b - a).otherwise(F.col("observed_seconds")))
    out = out.withColumns({f"{k}_minutes": F.col(f"{k}_seconds") / 60 for k in ("played", "bip", "tip", "otip")})
    return out.withColumns(
        {
            "gap_count": F.greatest(F.col("segment_count") - F.col("period_count"), F.lit(0)),
            "coverage_ratio": ratio(F.col("valid_seconds"), F.col("observed_seconds")),
            "played_tracking_coverage_ratio": ratio(F.col("valid_seconds"), F.col("played_seconds")),
            "bip_coverage_ratio": ratio(F.col("bip_seconds"), F.col("valid_seconds")),
        }
    )


def with_rates(rows: DataFrame) -> DataFrame:
    """Volumes by 60 live minutes, those of phases by 30 minutes of their own phase."""
    out = {f"{c}_p60_bip": ratio(F.col(c) * 3600, F.col("bip_seconds")) for c in VOLUMES if has(rows, c)}
    for phase in ("tip", "otip"):
        names = [c.format(phase) for c in PHASE_VOLUMES]
        out |= {f"{c}_p30_{phase}": ratio(F.col(c) * 1800, F.col(f"{phase}_seconds")) for c in names if has(rows, c)}
    return rows.withColumns(out)


def p60_rates(rows: DataFrame, columns: list[str], exposure: str = "bip_minutes", window: float = 60.0, suffix: str = "_p60_bip", played: str = "played_minutes", on_invalid: str = "drop") -> DataFrame:
    """Rates with guards: exposure positive and at most a minute above the time played; peaks are no volumes."""
    if set(columns) & {*PEAKS}:
        raise ValueError("peaks can't be divided by exposure")
    require(rows, [*columns, exposure, played])
    good = reduce(lambda a, b: a & b, [F.col(exposure) > 0, F.col(exposure) <= F.col(played) + 1, *[number(c) >= 0 for c in columns]])
    good = F.coalesce(good, F.lit(False))
    if on_invalid == "raise" and not rows.filter(~good).isEmpty():
        raise ValueError("rows without a valid exposure or volume")
    return rows.filter(good).withColumns({f"{c}{suffix}": F.col(c) * window / F.col(exposure) for c in columns})


def p30_rates(rows: DataFrame, columns: list[str], phase: str = "tip", **more) -> DataFrame:
    """Volumes by 30 minutes of a phase (tip or otip), guarded by the phase's own minutes."""
    return p60_rates(rows, columns, f"{phase}_minutes", 30.0, f"_p30_{phase}", **more)


def p90_rates(rows: DataFrame, columns: list[str], **more) -> DataFrame:
    """Volumes by 90 minutes played."""
    return p60_rates(rows, columns, "played_minutes", 90.0, "_p90", **more)


def eligible(rows: DataFrame, least_minutes: float = 60.0) -> DataFrame:
    return rows.filter(F.col("played_minutes") >= least_minutes)


def population(rows: DataFrame, kind: str) -> DataFrame:
    """all, or outfield: a known group that isn't a goalkeeper's, and no raw position that is."""
    if kind == "all":
        return rows
    keeper = lambda c: F.lower(F.trim(F.col(c).cast("string"))).isin(GOALKEEPERS)
    out = rows.filter(~keeper("position_group"))
    return out.filter(F.coalesce(~keeper("position"), F.lit(True))) if has(out, "position") else out


def qualified_outfield(rows: DataFrame, least_minutes: float = 60.0, least_matches: int = 2) -> DataFrame:
    """Performances of outfield players with enough minutes, of players with enough such matches."""
    good = rows.filter((F.col("played_minutes") >= least_minutes) & (F.col("position_group") != "Goalkeeper"))
    often = good.groupBy("player_id").agg(F.countDistinct("match_id").alias("n")).filter(F.col("n") >= least_matches)
    return good.join(often, "player_id", "left_semi")


def profiles(rows: DataFrame) -> DataFrame:
    """A season's profile of each player: sums of volumes over sums of exposure, strongest peaks, the commonest group."""
    exposures = [e for e, *_ in PROFILE if has(rows, e)]
    volumes = [c for e, _, _, cs in PROFILE if e in exposures for c in cs if has(rows, c)]
    out = rows.groupBy("player_id").agg(
        F.min("player_name").alias("player_name"), F.mode("position_group", True).alias("position_group"),
        F.countDistinct("match_id").alias("matches"), F.sum("played_minutes").alias("played_minutes"),
        *[F.sum(c).alias(c) for c in [*exposures, *volumes]], *[F.max(c).alias(c) for c in PEAKS if has(rows, c)],
    )
    rates = {f"{c}{suffix}": ratio(F.col(c) * window, F.col(e)) for e, window, suffix, cs in PROFILE if e in exposures for c in cs if c in volumes}
    return out.withColumns(rates).drop(*volumes)


def group_percentiles(rows: DataFrame, metrics: list[str], by: str | None = "position_group") -> DataFrame:
    return with_rank_percent(rows, [m for m in metrics if has(rows, m)], [by] if by else [])


def league(rows: DataFrame, metrics: list[str], by: list[str], kind: str = "outfield", weighting: str = "performance", least_minutes: float = 60.0, least_performances: int = 1, dispersion: bool = False) -> DataFrame:
    """Means over qualified performances, or over the means of players; with spread if asked."""
    require(rows, [*by, "match_id", "player_id", "played_minutes", *metrics])
    own = population(eligible(rows, least_minutes), kind).withColumns({m: number(m) for m in metrics}).dropna(subset=metrics)
    if least_performances > 1:
        often = own.groupBy(*by, "player_id").agg(F.countDistinct("match_id").alias("n")).filter(F.col("n") >= least_performances)
        own = own.join(often, [*by, "player_id"], "left_semi")
    spread = [F.stddev_samp(m).alias(f"{m}_sd") for m in metrics] if dispersion else []
    counts = [F.countDistinct("player_id").alias("n_players"), F.count(F.lit(1)).alias("n_performances")]
    if weighting == "performance":
        out = own.groupBy(*by).agg(*counts, *[F.avg(m).alias(m) for m in metrics], *spread)
    else:
        means = own.groupBy(*by, "player_id").agg(*[F.avg(m).alias(m) for m in metrics])
        out = own.groupBy(*by).agg(*counts, *spread).join(means.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics]), by)
    if dispersion:
        out = out.withColumns({f"{m}_se": F.col(f"{m}_sd") / F.sqrt("n_performances") for m in metrics})
    return out.withColumns({"population": F.lit(kind), "weighting": F.lit(f"{weighting}_weighted")})


def league_rates(rows: DataFrame, columns: list[str], by: list[str], **more) -> DataFrame:
    """The league's means of all guarded rates by 60 live minutes of the given volumes."""
    return league(p60_rates(rows, columns), [f"{c}_p60_bip" for c in columns], by, **more)


def league_variants(rows: DataFrame, metrics: list[str], by: list[str], **more) -> DataFrame:
    """Both populations under both weightings."""
    parts = [league(rows, metrics, by, kind, weighting, **more) for kind in ("all", "outfield") for weighting in ("performance", "player")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def benchmark(ours: DataFrame, metrics: list[str], by: list[str], published: DataFrame) -> DataFrame:
    """Our means beside published ones (published: by, metric, value; a few rows): difference and relative difference."""
    long = ours.unpivot(by, metrics, "metric", "ours")
    out = long.join(published.select(*by, "metric", F.col("value").alias("published")), [*by, "metric"], "left")
    return out.withColumns({"difference": F.col("ours") - F.col("published"), "relative": ratio(F.col("ours") - F.col("published"), F.col("published"))})


def coverage(frame: DataFrame) -> DataFrame:
    """By match: shares of live frames, by frames and by player rows, and of detected positions."""
    ball = F.coalesce(F.col("ball").cast("boolean"), F.lit(False))
    alive, seen = F.coalesce(F.col("ball_state") == "alive", F.lit(False)), F.coalesce(F.col("is_detected").cast("boolean"), F.lit(False))
    n = lambda *flags: F.count_if(reduce(lambda a, b: a & b, flags))
    out = frame.groupBy("match_id").agg(
        n(ball).alias("frames"), n(~ball).alias("player_rows"), n(ball, alive).alias("__lf"), n(ball, ~alive).alias("__df"),
        n(~ball, alive).alias("__lr"), n(~ball, ~alive).alias("__dr"), n(~ball, seen).alias("__s"), n(~ball, alive, seen).alias("__sl"),
    )
    r = lambda a, b: ratio(F.col(a), F.col(b))
    return out.select(
        "match_id", "frames", "player_rows", (r("__lf", "frames") * 100).alias("bip_frame_weighted_pct"), (r("__lr", "player_rows") * 100).alias("bip_player_weighted_pct"),
        r("__lr", "__lf").alias("players_per_live_frame"), r("__dr", "__df").alias("players_per_dead_frame"), r("__s", "player_rows").alias("detected_share"),
        r("__sl", "__lr").alias("detected_share_live"),
    )

