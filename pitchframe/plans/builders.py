"""From folders of files to tables in one call: matches, events on the common pitch, actions, shots, passes, action chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.coerce import has, identity
from pitchframe.operators import actions as A
from pitchframe.operators import shots_passes as P
from pitchframe.operators import value_chain as V
from pitchframe.sources import feeds, spadl

# Names of the JSON of a match.
MATCH_FILES = ["*_match.json", "match.json"]
KEYS = ["event_id", "match_id", "event_type", "event_subtype", "start_type", "end_type", "team_id", "team_shortname", "player_id", "player_name", "period", "frame_start", "frame_end", "pass_outcome", "carry", "lead_to_goal", "game_interruption_after"]
#: Columns of events that the tables below make something of; those that a file lacks are null.
COLUMNS = list(dict.fromkeys([*KEYS, *A.X_COLUMNS, *A.Y_COLUMNS, "player_targeted_xthreat", "player_targeted_dangerous", "player_targeted_xpass_completion", *P.SHOT_LABELS, *P.PASS_LABELS]))


def matches(spark: SparkSession, root: str, index: str | None = None, seasons: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """match_id, event file and match JSON (null if there is none) of the matches below root, in folders of any depth.

    With an index, those of its closed matches that have files, in its order; the first `limit`; an error if there is none."""
    events = feeds.files(spark, [root], feeds.EVENT_FILES).groupBy("match_id").agg(F.min("path").alias("path"))
    sheets = feeds.files(spark, [root], MATCH_FILES).groupBy("match_id").agg(F.min("path").alias("match_path"))
    found, order = events.join(sheets, "match_id", "left"), ["match_id"]
    if index:
        own = feeds.match_index(spark, index, seasons)
        order = [c for c in ("season_name", "date_time", "match_id") if has(own, c)]
        own = own.withColumn("match_id", identity("match_id")).select(*order).dropDuplicates(["match_id"])
        found = found.join(own, "match_id")
    found = found.orderBy(*order)
    found = found.limit(limit) if limit else found
    if found.isEmpty():
        raise FileNotFoundError(f"no event files below {root}")
    return found


def events(spark: SparkSession, chosen: DataFrame, kinds: list[str] | None = None, columns: list[str] = COLUMNS) -> DataFrame:
    """Events of the chosen matches with the constants of their match, places on the common pitch."""
    paths = chosen.select("path", "match_path").collect()  # two names a match: what readers take
    raw = feeds.dynamic_events(spark, [r["path"] for r in paths], columns, kinds)
    sheets = [r["match_path"] for r in paths if r["match_path"]]
    if not sheets:
        return A.with_match(raw, raw.select("match_id").distinct())
    out = A.with_match(raw, feeds.match_metadata(feeds.match_json(spark, sheets)))
    return A.on_common_pitch(out, F.col("raw_pitch_length"), F.col("raw_pitch_width"))


def action_table(spark: SparkSession, root: str, open_play_only: bool = True, **where) -> DataFrame:
    """Actions of all chosen matches in their canonical form, by match and event."""
    own = events(spark, matches(spark, root, **where), ["player_possession"])
    return A.prepared(A.from_possessions(own, open_play_only)).orderBy("match_id", "event_id")


def action_source(spark: SparkSession, kind: str, path: str, **where) -> DataFrame:
    """Actions from files of a feed ("files": a root) or from Parquet that was cached ("cache": a glob)."""
    if kind not in ("files", "cache"):
        raise ValueError("kind is files or cache")
    return action_table(spark, path, **where) if kind == "files" else A.prepared(feeds.cached_actions(spark, path))


def of_seasons(rows: DataFrame, per_season: int | None, in_all: int | None) -> DataFrame:
    """Rows of the first matches of each season, by kick-off and id, then of the first in all."""
    if per_season is None and in_all is None:
        return rows
    known = rows.select("match_id", *[c if has(rows, c) else F.lit(None).cast("string").alias(c) for c in ("season_name", "kickoff_time")]).distinct()
    some = P.first_of_each_season(known, per_season, ["kickoff_time", "match_id"], in_all)
    return rows.join(some.select("match_id"), "match_id", "left_semi")


def shot_table(spark: SparkSession, root: str, per_season: int | None = None, in_all: int | None = None, **where) -> DataFrame:
    return P.shot_rows(of_seasons(events(spark, matches(spark, root, **where), ["player_possession"]), per_season, in_all))


def pass_table(spark: SparkSession, root: str, per_season: int | None = None, in_all: int | None = None, **where) -> DataFrame:
    return P.pass_rows(of_seasons(events(spark, matches(spark, root, **where), ["player_possession"]), per_season, in_all))


def chain_table(spark: SparkSession, event_paths: list[str], games: DataFrame, periods: int = 5) -> DataFrame:
    """Event JSON to canonical actions with the score before each: what value_run takes."""
    raw = spadl.events(spark, event_paths)
    return V.with_score(V.canonical(spadl.to_actions(raw, games), {str(k): k for k in range(1, periods + 1)}), ["source_index"])
