"""Event feeds of nested JSON to the common action language: kinds, results, body parts, metres with home attacking +x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.pitch import LENGTH, WIDTH

NAME = "struct<id:long,name:string>"
EVENT = f"""id string, index long, period int, timestamp string, type {NAME}, team {NAME}, player {NAME}, location array<double>,
pass struct<end_location:array<double>,outcome:{NAME},type:{NAME},body_part:{NAME},cross:boolean>,
shot struct<end_location:array<double>,outcome:{NAME},type:{NAME},body_part:{NAME}>,
carry struct<end_location:array<double>>, dribble struct<outcome:{NAME}>, duel struct<type:{NAME},outcome:{NAME}>,
interception struct<outcome:{NAME}>, goalkeeper struct<type:{NAME},outcome:{NAME}>, clearance struct<body_part:{NAME}>,
foul_committed struct<card:{NAME}>"""
FEED_LENGTH, FEED_WIDTH = 120.0, 80.0
# Set pieces, keepers' acts and the remaining kinds by the feed's names.
PASS_TYPES = {"Throw-in": "throw_in", "Goal Kick": "goalkick"}
KEEPER = {"Shot Saved": "keeper_save", "Save": "keeper_save", "Penalty Saved": "keeper_save", "Collected": "keeper_claim", "Punch": "keeper_punch", "Smother": "keeper_claim"}
OTHERS = {
    "Carry": "dribble", "Dribble": "take_on", "Foul Committed": "foul", "Interception": "interception", "Clearance": "clearance",
    "Miscontrol": "bad_touch", "Own Goal Against": "bad_touch", "Ball Recovery": "ball_recovery", "Dispossessed": "dispossessed", "Block": "shot_block",
}
WON = ["Won", "Success", "Success In Play", "Success Out", "Complete"]


def _mapped(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row an event, with the id of the match: the digits of the file's name."""
    raw = spark.read.json(paths, schema=EVENT, multiLine=True)
    return raw.withColumn("match_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json", 1))


def matches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """match_id, teams and season of a competition's list, in the order of ids."""
    team = lambda side: f"struct<{side}_team_id:string,{side}_team_name:string>"
    raw = spark.read.json(paths, schema=f"match_id string, match_date string, home_team {team('home')}, away_team {team('away')}, season struct<season_name:string>", multiLine=True)
    return raw.select("match_id", "match_date", "home_team.home_team_id", "away_team.away_team_id", F.col("season.season_name").alias("season_name")).orderBy("match_id")


def player_directory(raw: DataFrame) -> DataFrame:
    """One name a player: the least, so that the order of files doesn't matter."""
    named = raw.filter("player.id is not null").select(F.col("player.id").cast("string").alias("player_id"), F.col("player.name").alias("player_name"))
    return named.groupBy("player_id").agg(F.min("player_name").alias("player_name"))


def type_of() -> Column:
    kind, of_pass = F.col("type.name"), F.col("pass.type.name")
    crossed = F.coalesce("pass.cross", F.lit(False))
    set_piece = lambda name: F.when(crossed, f"{name}_crossed").otherwise(f"{name}_short")
    passed = (
        F.when(of_pass == "Free Kick", set_piece("freekick")).when(of_pass == "Corner", set_piece("corner"))
        .when(of_pass.isin(list(PASS_TYPES)), _mapped(of_pass, PASS_TYPES)).when(crossed, "cross").otherwise("pass")
    )
    shot = F.when(F.col("shot.type.name") == "Free Kick", "shot_freekick").when(F.col("shot.type.name") == "Penalty", "shot_penalty").otherwise("shot")
    return (
        F.when(kind == "Pass", passed).when(kind == "Shot", shot).when(kind == "Goal Keeper", _mapped(F.col("goalkeeper.type.name"), KEEPER))
        .when((kind == "Duel") & (F.col("duel.type.name") == "Tackle"), "tackle").otherwise(_mapped(kind, OTHERS))
    )


def result_of() -> Column:
    kind, success, fail = F.col("type.name"), F.lit("success"), F.lit("fail")
    outcome = F.col("pass.outcome.name")
    won = lambda c: F.when(F.coalesce(F.col(c).isin(WON), F.lit(False)), success).otherwise(fail)
    card = F.col("foul_committed.card.name")
    return (
        F.when(kind == "Pass", F.when(outcome.isNull(), success).when(outcome == "Pass Offside", "offside").otherwise(fail))
        .when(kind == "Shot", F.when(F.col("shot.outcome.name") == "Goal", success).otherwise(fail))
        .when(kind == "Dribble", F.when(F.col("dribble.outcome.name") == "Incomplete", fail).otherwise(success))
        .when(kind == "Duel", won("duel.outcome.name")).when(kind == "Interception", won("interception.outcome.name"))
        .when(kind == "Foul Committed", F.when(card.contains("Yellow"), "yellow_card").when(card.contains("Red"), "red_card").otherwise(fail))
        .when(kind == "Own Goal Against", "owngoal").when(kind.isin("Miscontrol", "Dispossessed"), fail).otherwise(success)
    )


def body_of() -> Column:
    part = F.coalesce("pass.body_part.name", "shot.body_part.name", "clearance.body_part.name")
    return F.when(part.contains("Head"), "head").when(part.contains("Foot"), "foot").when(part.isNotNull(), "other").otherwise("foot")


def clock_seconds(text: Column) -> Column:
    """hh:mm:ss.fff as seconds; null if it can't be read."""
    part = lambda k: F.try_element_at(F.split(text, ":"), F.lit(k)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def to_actions(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Events to actions; rows of kinds without a counterpart have a null type and go when they are made canonical."""
    x = lambda place: F.try_element_at(place, F.lit(1)) / FEED_LENGTH * LENGTH - LENGTH / 2
    y = lambda place: WIDTH / 2 - F.try_element_at(place, F.lit(2)) / FEED_WIDTH * WIDTH
    end = F.coalesce("pass.end_location", "shot.end_location", "carry.end_location")
    own = raw.join(games, "match_id").withColumn("team_id", F.col("team.id").cast("string"))
    side = F.when(F.col("team_id") == F.col("home_team_id"), 1.0).otherwise(-1.0)
    return own.select(
        "match_id", "season_name", "home_team_id", "away_team_id", "team_id", F.col("player.id").cast("string").alias("player_id"),
        F.col("period").cast("string").alias("period_id"), clock_seconds(F.col("timestamp")).alias("time_seconds"), F.col("index").alias("source_index"),
        type_of().alias("type_name"), result_of().alias("result_name"), body_of().alias("bodypart_name"),
        (x(F.col("location")) * side).alias("start_x"), (y(F.col("location")) * side).alias("start_y"),
        (x(end) * side).alias("end_x"), (y(end) * side).alias("end_y"),
    )
