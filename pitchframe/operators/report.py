"""Relations behind reports: heat maps, danger zones, sequences, leaders, cross tables, surfaces of differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import number, ratio, ratio_or_zero
from pitchframe.functions.pitch import LENGTH, WIDTH, cell_x, cell_y, route_channel

MOVES = ["pass", "carry"]


def has_team(df: DataFrame, column: str = "team_shortname") -> DataFrame:
    """Rows that name a team."""
    name = F.trim(F.col(column).cast("string"))
    return df.filter(name.isNotNull() & ~name.isin("", "<NA>", "nan", "None"))


def heat_map(df: DataFrame, x: str, y: str, columns: int, rows: int, weight: str | None = None, least: int = 0) -> DataFrame:
    """x_bin, y_bin, n, total and mean weight; the last bins hold their right edges, places off the pitch are left out."""
    own = df.filter(F.col(x).between(-LENGTH / 2, LENGTH / 2) & F.col(y).between(-WIDTH / 2, WIDTH / 2))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    out = own.groupBy(cell_x(F.col(x), columns).alias("x_bin"), cell_y(F.col(y), rows).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("total"), F.avg(w).alias("mean"))
    return out.filter(F.col("n") >= least)


def danger_rows(scored: DataFrame, value: str, columns: int = 16, rows: int = 12, positive_only: bool = True) -> DataFrame:
    """Moves of teams with the cells of both ends, and what they count for."""
    own = has_team(scored).filter(F.col("action_type").isin(MOVES)).dropna(subset=["start_x", "start_y", "end_x", "end_y"])
    net = F.coalesce(number(value), F.lit(0.0))
    return own.withColumns(
        {
            "net_value": net, "value": F.greatest(net, F.lit(0.0)) if positive_only else net, "progression": F.col("end_x") - F.col("start_x"),
            "x_cell": cell_x(F.col("start_x"), columns), "y_cell": cell_y(F.col("start_y"), rows),
            "end_x_cell": cell_x(F.col("end_x"), columns), "end_y_cell": cell_y(F.col("end_y"), rows),
        }
    )


def danger_cells(danger: DataFrame, columns: int = 16, rows: int = 12, team: str = "team_shortname") -> DataFrame:
    """A row for every cell of every team, those without actions too: the grid of each team is made from its name."""
    sums = danger.groupBy(team, "x_cell", "y_cell").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(F.col("action_type") == "pass").alias("passes"), F.count_if(F.col("action_type") == "carry").alias("carries"),
        F.sum("value").alias("xT"), F.sum("net_value").alias("net_xT"), F.avg("value").alias("avg_xT"), F.avg("progression").alias("avg_progression"),
    )
    grid = danger.select(team).distinct().select(team, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y_cell"))
    grid = grid.select(team, "y_cell", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("x_cell"))
    out = grid.join(sums, [team, "x_cell", "y_cell"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("actions", "passes", "carries")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("xT", "net_xT", "avg_xT", "avg_progression")})
    return out.withColumn("xT_per_100", ratio_or_zero(F.col("xT"), F.col("actions")) * 100)


def _total(column: str) -> Column:
    """The sum to nine places, so that equal sums tie however their terms were added up."""
    return F.round(F.sum(column), 9)


def _top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", at).filter(F.col("place") <= n)


def danger_players(danger: DataFrame, top: int = 5, team: str = "team_shortname", player: str = "player_name") -> DataFrame:
    """The leading players of each cell."""
    sums = danger.groupBy(team, "x_cell", "y_cell", player).agg(F.count(F.lit(1)).alias("actions"), _total("value").alias("xT"), F.sum("net_value").alias("net_xT"))
    return _top(sums, [team, "x_cell", "y_cell"], [F.desc("xT"), F.asc(player)], top)


def danger_destinations(danger: DataFrame, top: int = 24, positive_only: bool = True, team: str = "team_shortname") -> DataFrame:
    """Where the actions of each cell go."""
    sums = danger.groupBy(team, "x_cell", "y_cell", "end_x_cell", "end_y_cell").agg(
        F.count(F.lit(1)).alias("actions"), _total("value").alias("xT"), F.sum("net_value").alias("net_xT"), F.avg("value").alias("avg_xT"), F.avg("progression").alias("avg_progression")
    )
    sums = sums.filter("avg_xT > 0") if positive_only else sums  # least sums round to 0
    return _top(sums, [team, "x_cell", "y_cell"], [F.desc("xT"), F.asc("end_y_cell"), F.asc("end_x_cell")], top)


def danger_routes(danger: DataFrame, top: int = 8, team: str = "team_shortname", tie: str = "event_id") -> DataFrame:
    """The single actions of each cell that count for most."""
    return _top(danger, [team, "x_cell", "y_cell"], [F.desc("value"), F.asc(tie)], top)


def danger_payload(danger: DataFrame, columns: int = 16, rows: int = 12, team: str = "team_shortname", player: str = "player_name", tie: str = "event_id") -> DataFrame:
    """team, payload: a JSON tree of each team's cells with their players, destinations and routes.

    What is nested is bounded by the grid and the tops, and grouped by team and cell before by team."""
    r = lambda c, n: F.round(F.col(c), n)
    key = [team, "x_cell", "y_cell"]
    nest = lambda df, name, *cols: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias(name))
    players = nest(danger_players(danger, 5, team, player), "players", F.col(player).alias("name"), "actions", r("xT", 4).alias("xT"), r("net_xT", 4).alias("netX"))
    zones = nest(danger_destinations(danger, 24, True, team), "destinationZones", F.col("end_x_cell").alias("xCell"), F.col("end_y_cell").alias("yCell"), "actions", r("xT", 4).alias("xT"), r("avg_progression", 3).alias("avgProg"))
    routes = nest(danger_routes(danger, 8, team, tie), "routes", F.col(player).alias("player"), F.col("action_type").alias("type"), *[r(c, 3).alias(a) for c, a in (("start_x", "sx"), ("start_y", "sy"), ("end_x", "ex"), ("end_y", "ey"))], r("value", 4).alias("xT"))
    cells = danger_cells(danger, columns, rows, team)
    for part in (players, zones, routes):
        cells = cells.join(part, key, "left")
    dx, dy = LENGTH / columns, WIDTH / rows
    shown = F.struct(
        F.col("y_cell").alias("yCell"), F.col("x_cell").alias("xCell"), *[F.round(o + (F.col(c) + k) * d, 3).alias(f"{a}{k}") for c, a, o, d in (("x_cell", "x", -LENGTH / 2, dx), ("y_cell", "y", -WIDTH / 2, dy)) for k in (0, 1)],
        "actions", "passes", "carries", r("xT", 4).alias("xT"), r("net_xT", 4).alias("netX"), r("avg_xT", 6).alias("avgX"), r("xT_per_100", 4).alias("xTPer100"),
        r("avg_progression", 3).alias("avgProg"), F.slice("destinationZones", 1, 5).alias("endZones"), "destinationZones", "players", "routes",
    )
    whole = F.struct(F.sum("actions").alias("actions"), F.round(F.sum("xT"), 4).alias("xT"), F.round(F.sum("net_xT"), 4).alias("netX"), F.round(F.max("xT"), 4).alias("maxCellX"))
    out = cells.groupBy(team).agg(whole.alias("summary"), F.array_sort(F.collect_list(shown)).alias("cells"))
    return out.select(F.col(team).alias("team"), F.to_json(F.struct(F.col(team).alias("team"), "summary", "cells")).alias("payload"))


def route_value(scored: DataFrame, value: str, by: list[str], kinds: list[str] = MOVES) -> DataFrame:
    """Threat by channel of the route and kind of action, absent pairs 0, as a sum for each kind."""
    own = scored.withColumn("route_channel", F.coalesce(route_channel(F.col("start_y"), F.col("end_y")), F.lit("unknown")))
    v = F.coalesce(F.col(value), F.lit(0.0))
    return own.groupBy(*by, "route_channel").agg(*[F.sum(F.when(F.col("action_type") == k, v).otherwise(0.0)).alias(f"xT_{k}") for k in kinds])


def sequence_trajectory(scored: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """The running sum of value along each sequence, and the number of each action in it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return scored.withColumns({"action_number": F.count(F.lit(1)).over(w), "cumulative": F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)})


def top_sequences(scored: DataFrame, summary: DataFrame, keys: list[str], n: int, value: str = "xT") -> DataFrame:
    """The rows of the n sequences of most value, by a semi join."""
    best = summary.orderBy(F.desc_nulls_last(value), *keys).limit(n)
    return scored.join(F.broadcast(best.select(*keys)), keys, "left_semi")  # n rows


def top_and_bottom(df: DataFrame, metric: str, n: int, tie: list[str]) -> DataFrame:
    """The n highest and the n lowest rows, tagged."""
    known = df.filter(F.col(metric).isNotNull())
    top = known.orderBy(F.desc(metric), *tie).limit(n).withColumn("group", F.lit("top"))
    return top.unionByName(known.orderBy(F.asc(metric), *tie).limit(n).withColumn("group", F.lit("bottom")))


def farthest_from_middle(df: DataFrame, x: str, y: str, n: int, tie: list[str]) -> DataFrame:
    """The n rows farthest from the medians, in units of each column's deviation."""
    spread = df.agg(*[f(c).alias(f"__{k}_{c}") for c in (x, y) for k, f in (("m", lambda c: F.percentile(c, 0.5)), ("s", F.stddev_samp))])
    both = df.join(F.broadcast(spread))  # one row
    part = lambda c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) ** 2
    out = both.withColumn("distance", F.sqrt(part(x) + part(y))).select(*df.columns, "distance")
    return out.orderBy(F.desc_nulls_last("distance"), *tie).limit(n)


def row_shares(df: DataFrame, row: str, column: str, values: list[str], other: str = "other") -> DataFrame:
    """Shares of the values of a column in each row of a cross table, all further values together."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    out = df.groupBy(row).agg(F.count(F.lit(1)).alias("n"), *counts, F.count_if(~F.coalesce(F.col(column).isin(values), F.lit(False))).alias(other))
    return out.select(row, "n", *[ratio(F.col(f"`{v}`"), F.col("n")).alias(v) for v in [*values, other]])


def mean_of_least(df: DataFrame, by: list[str], value: str, n: int = 3) -> DataFrame:
    """The mean of the n least values of each group, and how many there were."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(value))
    some = df.filter(F.col(value).isNotNull()).withColumn("__n", at).filter(F.col("__n") <= n)
    return some.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows wherever it runs."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def band_composition(rows: DataFrame, by: str = "position_group") -> DataFrame:
    bands = ["running_distance_m_p60_bip", "hsr_distance_m_p60_bip", "sprint_distance_m_p60_bip"]
    return rows.groupBy(by).agg(*[F.avg(c).alias(c) for c in bands])


def final_third_entries(passes: DataFrame) -> DataFrame:
    """Passes that come into the last third, by the feed's label or by x."""
    edge = LENGTH / 6
    label = F.coalesce((F.col("third_start") != "attacking_third") & (F.col("player_targeted_third_pass") == "attacking_third"), F.lit(False))
    return passes.filter(label | F.coalesce((F.col("passer_x") < edge) & (F.col("target_x") >= edge), F.lit(False)))


def player_frame(rows: DataFrame, season: str | None = None, least_passes: int = 0, without_keepers: bool = True) -> DataFrame:
    out = rows.filter(F.col("season_name") == season) if season is not None else rows
    out = out.filter(F.col("passes") >= least_passes)
    return out.filter(F.coalesce(F.upper("player_position") != "GK", F.lit(True))) if without_keepers else out


def labelled_once(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two picks of rows, each row once."""
    return a.unionByName(b).dropDuplicates(keys)
