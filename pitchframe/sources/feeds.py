"""Scans of provider feeds: match index, event and phase CSV, match JSON, tracking JSONL, line-ups, season aggregates.

All paths go through Spark's readers, so they may lie in any store that Spark reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.coerce import has, number
from pitchframe.functions.pitch import LENGTH, WIDTH, rescaled
from pitchframe.operators.physical import resolved_group

# Names of the files of a match, and of periods.
EVENT_FILES = ["*_dynamic_events.csv", "dynamic_events.csv"]
PERIODS = {"first_half": 1, "second_half": 2, "first_half_extratime": 3, "second_half_extratime": 4, "shootout": 5}
TEAM = "struct<id:string,name:string,short_name:string>"
MATCH = f"""id string, date_time string, pitch_length double, pitch_width double, home_team {TEAM}, away_team {TEAM},
home_team_score long, away_team_score long, home_team_side array<string>,
competition_edition struct<competition:struct<id:string,name:string>,season:struct<id:string,name:string>>,
competition_round struct<id:string,name:string,round_number:long>,
match_periods array<struct<period:int,name:string,start_frame:long,end_frame:long>>,
players array<struct<id:string,team_id:string,short_name:string,number:int,start_time:string,
player_role:struct<name:string,acronym:string,position_group:string>,
playing_time:struct<total:struct<minutes_played:double,start_frame:long,end_frame:long>>>>"""
FRAME = """frame long, timestamp string, period int, ball_data struct<x:double,y:double,z:double,is_detected:boolean>,
possession struct<player_id:string,group:string>, player_data array<struct<x:double,y:double,player_id:string,is_detected:boolean>>"""
FPS = 10.0


def match_id_of(path: Column) -> Column:
    """Digits that begin a file's name, else the name of its folder."""
    own = F.regexp_extract(path, r"/(\d+)_[^/]*$", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1))


def files(spark: SparkSession, roots: list[str], names: list[str]) -> DataFrame:
    """path and match_id of the files below roots whose names match; contents aren't read."""
    parts = [
        spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=n).load(roots).select("path") for n in names
    ]
    found = reduce(DataFrame.union, parts).distinct()
    return found.select("path", match_id_of(F.col("path")).alias("match_id"))


def discovered_matches(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """match_id and event file of each match below root, the first `limit` by id; an error if there is none."""
    found = files(spark, [root], EVENT_FILES).groupBy("match_id").agg(F.min("path").alias("path"))
    found = found.orderBy("match_id").limit(limit) if limit else found
    if found.isEmpty():
        raise FileNotFoundError(f"no event files below {root}")
    return found


def text_csv(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """CSV files as text. Only `columns` are read; those that a file lacks are null.

    Files are grouped by their header line, so that files of different shapes don't shift each other's columns."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id())
    heads = lines.groupBy("path").agg(F.min_by("value", "n").alias("head")).groupBy("head").agg(F.collect_list("path").alias("paths"))
    parts = []
    for row in heads.collect():  # a row for each shape of file
        part = spark.read.csv(row["paths"], header=True, enforceSchema=False, multiLine=False)
        wanted = columns if columns is not None else part.columns
        own = [(F.col(f"`{c}`") if c in part.columns else F.lit(None)).cast("string").alias(c) for c in wanted]
        parts.append(part.select(*own, F.col("_metadata.file_path").alias("__path")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def match_index(spark: SparkSession, path: str, seasons: list[str] | None = None, with_open: bool = False) -> DataFrame:
    """Closed matches of the index, of some seasons if asked, in a stable order."""
    out = text_csv(spark, [path]).drop("__path")
    if seasons:
        out = out.filter(F.col("season_name").isin([str(s) for s in seasons]))
    if not with_open and has(out, "status"):
        out = out.filter(F.lower("status") == "closed")
    return out.orderBy(*[c for c in ("season_name", "date_time", "match_id") if has(out, c)])


def dynamic_events(spark: SparkSession, paths: list[str], columns: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Event rows as text, with their match's id, of some kinds of events if asked."""
    named = list(dict.fromkeys([*columns, "match_id", "event_type"]))
    out = text_csv(spark, paths, named)
    out = out.withColumn("match_id", F.coalesce(F.col("match_id"), match_id_of(F.col("__path")))).drop("__path")
    return out.filter(F.col("event_type").isin(kinds)) if kinds else out


def phases_of_play(spark: SparkSession, paths: list[str]) -> DataFrame:
    return text_csv(spark, paths).drop("__path")


def season_aggregate(spark: SparkSession, paths: list[str], numbers: list[str]) -> DataFrame:
    """A provider's physical table by season; `numbers` become doubles."""
    out = text_csv(spark, paths).drop("__path")
    return out.withColumns({c: number(c) for c in numbers if has(out, c)})


def match_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.json(paths, schema=MATCH, multiLine=True)
    return raw.withColumn("match_id", F.coalesce(F.col("id"), match_id_of(F.col("_metadata.file_path"))))


def match_metadata(raw: DataFrame) -> DataFrame:
    """One flat row a match; pitch sizes that are missing or 0 are the common ones."""
    size = lambda c, usual: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(usual))
    edition = "competition_edition"
    both = F.col("home_team_score").isNotNull() & F.col("away_team_score").isNotNull()
    return raw.select(
        "match_id",
        F.col(f"{edition}.competition.id").alias("competition_id"), F.col(f"{edition}.competition.name").alias("competition_name"),
        *[F.col(f"competition_round.{a}").alias(f"competition_round_{b}") for a, b in (("id", "id"), ("name", "name"), ("round_number", "number"))],
        F.col(f"{edition}.season.id").alias("season_id"), F.col(f"{edition}.season.name").alias("season_name"),
        F.col("date_time").alias("kickoff_time"),
        *[F.col(f"{side}_team.{a}").alias(f"{side}_team_{b}") for side in ("home", "away") for a, b in (("id", "id"), ("name", "name"), ("short_name", "shortname"))],
        F.col("home_team_score").alias("final_home_score"), F.col("away_team_score").alias("final_away_score"),
        F.when(both, F.concat_ws("-", F.col("home_team_score").cast("string"), F.col("away_team_score").cast("string"))).alias("final_score"),
        size("pitch_length", LENGTH).alias("raw_pitch_length"), size("pitch_width", WIDTH).alias("raw_pitch_width"),
    )


def lineups(raw: DataFrame, fps: float = FPS) -> DataFrame:
    """A row a player and match, with the times of the appearance counted from the first frame."""
    first = F.array_min(F.transform("match_periods", lambda p: p["start_frame"]))
    rows = raw.select("match_id", first.alias("__first"), F.col("home_team.id").alias("__home"), F.col("away_team.id").alias("__away"), F.explode("players").alias("p"))
    total = "p.playing_time.total"
    clock = lambda c: F.greatest((F.col(f"{total}.{c}") - F.col("__first")) / fps, F.lit(0.0))
    known = lambda c: F.when(F.col(f"{total}.{c}").isNotNull(), clock(c))
    return rows.select(
        "match_id", F.col("p.id").alias("player_id"), F.col("p.team_id").alias("team_id"),
        F.when(F.col("p.team_id") == F.col("__home"), "home").when(F.col("p.team_id") == F.col("__away"), "away").alias("home_away"),
        F.col("p.short_name").alias("player_name"), F.col("p.number").alias("uniform_number"), F.col("p.player_role.name").alias("position"),
        resolved_group(F.col("p.player_role.position_group"), F.col("p.player_role.name")).alias("position_group"),
        (F.col("p.start_time") == "00:00:00").alias("starting"),
        known("start_frame").alias("appearance_start_seconds"), known("end_frame").alias("appearance_end_seconds"),
        (F.col(f"{total}.minutes_played") * 60000).alias("provider_playing_time_ms"),
    )


def tracking_rows(frames: DataFrame, raw: DataFrame, players: DataFrame, fps: float = FPS) -> DataFrame:
    """Frames (FRAME with match_id) to a row an object and frame: metres, home attacking +x, owner and ball state.

    raw and players are a row a match and a row a player of it: small against frames, and joined by match."""
    period = lambda c: F.element_at(F.filter("match_periods", lambda p: p["period"] == F.col("period")), 1)[c]
    match = raw.select(
        "match_id", "pitch_length", "pitch_width", "match_periods", "home_team_side", F.col("home_team.id").alias("home_team_id"), F.col("away_team.id").alias("away_team_id"),
        F.array_min(F.transform("match_periods", lambda p: p["start_frame"])).alias("first_frame"),
    )
    ball = F.struct(F.lit("ball").alias("player_id"), F.lit(True).alias("ball"), *[F.col(f"ball_data.{c}").alias(c) for c in ("x", "y", "is_detected")])
    objects = F.concat(
        F.when(F.col("ball_data.x").isNotNull(), F.array(ball)).otherwise(F.array().cast("array<struct<player_id:string,ball:boolean,x:double,y:double,is_detected:boolean>>")),
        F.transform(F.coalesce("player_data", F.array().cast("array<struct<x:double,y:double,player_id:string,is_detected:boolean>>")), lambda p: F.struct(p["player_id"].alias("player_id"), F.lit(False).alias("ball"), p["x"].alias("x"), p["y"].alias("y"), p["is_detected"].alias("is_detected"))),
    )
    group = F.lower("possession.group")
    rows = frames.filter("period is not null").join(match, "match_id").select(
        "match_id", F.col("period").alias("period_id"), F.col("frame").alias("frame_id"), F.col("timestamp").alias("source_timestamp"),
        ((F.col("frame") - period("start_frame")) / fps).alias("timestamp"), ((F.col("frame") - F.col("first_frame")) / fps).alias("match_seconds"),
        F.when(group == "home team", F.col("home_team_id")).when(group == "away team", F.col("away_team_id")).alias("ball_owning_team_id"),
        F.when(F.try_element_at("home_team_side", F.when(F.col("period") > 0, F.col("period")).otherwise(1)) == "right_to_left", -1.0).otherwise(1.0).alias("__side"),
        "pitch_length", "pitch_width", F.explode(objects).alias("o"),
    )
    side = F.col("__side")
    rows = rows.select(
        "match_id", "period_id", "frame_id", "timestamp", "match_seconds", "source_timestamp", "o.player_id", "o.ball", "o.is_detected", "ball_owning_team_id",
        F.when(F.col("ball_owning_team_id").isNotNull(), "alive").otherwise("dead").alias("ball_state"),
        (rescaled(F.col("o.x"), F.nullif("pitch_length", F.lit(0.0)), LENGTH) * side).alias("x"), (rescaled(F.col("o.y"), F.nullif("pitch_width", F.lit(0.0)), WIDTH) * side).alias("y"),
    )
    return rows.join(players.select("match_id", "player_id", "team_id", "home_away"), ["match_id", "player_id"], "left")


def tracking_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Frames of JSONL files with their match's id. Lines are read in splits, never a match as a whole."""
    raw = spark.read.json(paths, schema=FRAME)
    return raw.withColumn("match_id", match_id_of(F.col("_metadata.file_path")))


def cached_actions(spark: SparkSession, pattern: str) -> DataFrame:
    """Parquet files of a glob, with the name of the folder of each."""
    found = spark.read.parquet(pattern)
    return found.withColumn("cache_dir", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


def first_frames(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the first n frames of each match, by a semi join on the frames."""
    from pyspark.sql import Window as W

    frames = rows.select("match_id", "period_id", "frame_id").distinct()
    at = F.row_number().over(W.partitionBy("match_id").orderBy("period_id", "frame_id"))
    some = frames.withColumn("__n", at).filter(F.col("__n") <= n).drop("__n")
    return rows.join(some, ["match_id", "period_id", "frame_id"], "left_semi")
