"""Possession threat on a grid: counts of cells as sparse relations, value iteration, rating and summaries.

Only counts of cells reach the driver (columns * rows cells and their pairs), however many actions there are."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.functions.coerce import has, ratio, ratio_or_zero
from pitchframe.functions.pitch import cell
from pitchframe.functions.shared import landed

COLUMNS, ROWS = 16, 12
EPSILON, MOST_ROUNDS = 1e-5, 200
# Kinds of actions that move the ball, and those that shoot.
MOVE_KINDS, SHOT_KINDS = ["pass", "carry", "dribble", "cross"], ["shot", "shot_penalty", "shot_freekick"]


def _kind(df: DataFrame) -> Column:
    return F.lower(F.col("action_type").cast("string"))


def is_move(df: DataFrame) -> Column:
    return F.coalesce(_kind(df).isin(MOVE_KINDS), F.lit(False))


def is_shot(df: DataFrame) -> Column:
    return F.coalesce(_kind(df).isin(SHOT_KINDS), F.lit(False))


def _first_flag(df: DataFrame, names: list[str]) -> Column:
    own = next((c for c in names if has(df, c)), None)
    return F.coalesce(F.col(own).cast("boolean"), F.lit(False)) if own else F.lit(False)


def is_success(df: DataFrame) -> Column:
    return _first_flag(df, ["move_success", "outcome_flag"])


def is_goal(df: DataFrame) -> Column:
    return _first_flag(df, ["goal", "shot_goal_actual", "shot_goal"])


def with_cells(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """start_cell and end_cell, null where a coordinate is."""
    out = {}
    for side in ("start", "end"):
        x, y = F.col(f"{side}_x"), F.col(f"{side}_y")
        out[f"{side}_cell"] = F.when(x.isNotNull() & y.isNotNull(), cell(x, y, columns, rows))
    return actions.withColumns(out)


def cell_probabilities(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """cell, shots, goals, moves, p_goal, p_shot, p_move from one aggregation."""
    own = with_cells(actions, columns, rows).filter("start_cell is not null")
    counted = own.groupBy(F.col("start_cell").alias("cell")).agg(
        F.count_if(is_shot(own)).alias("shots"), F.count_if(is_shot(own) & is_goal(own)).alias("goals"), F.count_if(is_move(own)).alias("moves")
    )
    both = F.col("shots") + F.col("moves")
    return counted.select(
        "*",
        ratio_or_zero(F.col("goals"), F.col("shots")).alias("p_goal"),
        ratio_or_zero(F.col("shots"), both).alias("p_shot"),
        ratio_or_zero(F.col("moves"), both).alias("p_move"),
    )


def transitions(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """start_cell, end_cell, n, p: successful moves over all moves that know both ends. Rows of p sum to 1 at most."""
    own = with_cells(actions, columns, rows).filter("start_cell is not null and end_cell is not null")
    moves = own.filter(is_move(own)).groupBy("start_cell", "end_cell").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(is_success(own)).alias("n")
    )
    started = moves.groupBy("start_cell").agg(F.sum("all").alias("started"))
    return moves.join(started, "start_cell").filter("n > 0").select("start_cell", "end_cell", "n", ratio_or_zero(F.col("n"), F.col("started")).alias("p"))


@dataclass
class Surface:
    """Values of cells, row by row, with what they were made of."""

    columns: int
    rows: int
    values: list[float]
    rounds: int = 0
    top_first: bool = False
    history: list[list[float]] = field(default_factory=list)

    def lookup(self, x: Column, y: Column) -> Column:
        at = cell(x, y, self.columns, self.rows, self.top_first)
        return F.when(x.isNotNull() & y.isNotNull(), F.element_at(F.array(*map(F.lit, self.values)), at + 1))

    def matrix(self) -> list[list[float]]:
        return [self.values[r * self.columns : (r + 1) * self.columns] for r in range(self.rows)]

    def to_json(self) -> str:
        return json.dumps(self.matrix())

    @classmethod
    def from_json(cls, text: str, top_first: bool = False) -> Surface:
        grid = json.loads(text)
        return cls(len(grid[0]), len(grid), [float(v) for row in grid for v in row], top_first=top_first)


def fitted(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS, epsilon: float = EPSILON, most_rounds: int = MOST_ROUNDS) -> Surface:
    """value = p_goal * p_shot + p_move * sum(p(to) * value(to)), until no cell moves by more than epsilon."""
    n = columns * rows
    gain, stay, move = np.zeros(n), np.zeros(n), np.zeros((n, n))
    for r in cell_probabilities(actions, columns, rows).collect():  # a row for each cell
        gain[r["cell"]], stay[r["cell"]] = r["p_goal"] * r["p_shot"], r["p_move"]
    for r in transitions(actions, columns, rows).collect():  # a row for each pair of cells
        move[r["start_cell"], r["end_cell"]] = r["p"]
    values, history, k = np.zeros(n), [], 0
    for k in range(1, most_rounds + 1):
        new = gain + stay * (move @ values)
        history.append(new.tolist())
        change, values = np.abs(new - values).max(), new
        if change <= epsilon:
            break
    return Surface(columns, rows, values.tolist(), k, history=history)


def model_grid(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """One row: gain and stay of each cell, and the moves of each cell as (to, p). Its size is the grid's, whatever the actions'."""
    n = columns * rows
    cells = actions.sparkSession.range(n).select(F.col("id").cast("int").alias("cell"))
    chances = cell_probabilities(actions, columns, rows)
    moved = transitions(actions, columns, rows).groupBy("start_cell").agg(F.array_sort(F.collect_list(F.struct(F.col("end_cell").alias("to"), "p"))).alias("onward"))
    own = cells.join(chances, "cell", "left").join(moved.withColumnRenamed("start_cell", "cell"), "cell", "left")
    none = F.array().cast("array<struct<to:int,p:double>>")
    row = F.struct(
        "cell", F.coalesce(F.col("p_goal") * F.col("p_shot"), F.lit(0.0)).alias("gain"), F.coalesce("p_move", F.lit(0.0)).alias("stay"),
        F.coalesce(F.col("onward").cast("array<struct<to:int,p:double>>"), none).alias("moves"),
    )
    return own.agg(F.array_sort(F.collect_list(row)).alias("cells"))


def iterations(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS, epsilon: float = EPSILON, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Every round of the value iteration: round (from 1), cell, value, change (the largest of the round).

    A recursive query: a round is one row that holds all cells, and the recursion ends with the first round whose change
    is epsilon or less. Nothing of it passes the driver."""
    grid = landed(model_grid(actions, columns, rows), "threat-grid")  # else each round would count the actions again
    steps = actions.sparkSession.sql(
        f"""
        WITH RECURSIVE steps(round, value, change) MAX RECURSION LEVEL {most_rounds + 1} AS (
          SELECT 0, array_repeat(0D, {columns * rows}), CAST('Infinity' AS DOUBLE)
          UNION ALL
          SELECT round + 1, new, array_max(zip_with(new, value, (a, b) -> abs(a - b)))
          FROM (SELECT round, value, transform(cells, c -> c.gain + c.stay * aggregate(c.moves, 0D, (sum, m) -> sum + m.p * value[m.to])) AS new
                FROM steps CROSS JOIN {{grid}} WHERE change > {epsilon!r}D AND round < {most_rounds})
        )
        SELECT round, change, posexplode(value) AS (cell, value) FROM steps WHERE round > 0
        """,
        grid=grid,
    )
    return steps.select("round", "cell", "value", "change")


def converged(actions: DataFrame, columns: int = COLUMNS, rows: int = ROWS, epsilon: float = EPSILON, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The last round of the iteration: cell, rounds, value."""
    steps = iterations(actions, columns, rows, epsilon, most_rounds)
    last = F.max_by(F.struct("round", "value"), "round").alias("x")
    return steps.groupBy("cell").agg(last).select("cell", F.col("x.round").alias("rounds"), F.col("x.value").alias("value"))


def rated(actions: DataFrame, surface: Surface, unsuccessful: str = "nan", prefix: str = "xT") -> DataFrame:
    """<prefix>_start, _end and _added: the difference for successful moves; others null, 0 or what was lost."""
    if unsuccessful not in ("nan", "zero", "negative_start"):
        raise ValueError("unsuccessful must be nan, zero or negative_start")
    out = actions.withColumns(
        {f"{prefix}_{s}": surface.lookup(F.col(f"{s}_x"), F.col(f"{s}_y")) for s in ("start", "end")}
    )
    lost = {"nan": F.lit(None).cast("double"), "zero": F.lit(0.0), "negative_start": -F.col(f"{prefix}_start")}[unsuccessful]
    won = F.col(f"{prefix}_end") - F.col(f"{prefix}_start")
    return out.withColumn(f"{prefix}_added", F.when(is_move(out) & is_success(out), won).when(is_move(out), lost))


def summary(rated_actions: DataFrame, by: list[str], value: str = "xT_added", least_actions: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """Actions, matches, rated actions and threat by group; counts by kind come from the same aggregation."""
    v = F.col(value)
    out = rated_actions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("actions"),
        F.countDistinct("match_id").alias("matches"),
        F.count(v).alias("rated_actions"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("xT"),
        F.avg(v).alias("avg_xT"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("positive_xT"),
        *[F.count_if(F.col("action_type") == k).alias(f"n_{k}") for k in kinds or []],
    )
    per = F.col("rated_actions")
    out = out.withColumns({"xT_per_100": ratio(F.col("xT"), per) * 100, "positive_xT_per_100": ratio(F.col("positive_xT"), per) * 100})
    return out.filter(F.col("actions") >= least_actions)


def metrics(rated_actions: DataFrame, value: str = "xT_added") -> DataFrame:
    """One row for a whole table."""
    v, n = F.col(value), F.greatest(F.count(F.col(value)), F.lit(1))
    return rated_actions.agg(
        F.count(F.lit(1)).alias("actions"), F.countDistinct("match_id").alias("matches"), F.count(v).alias("rated_actions"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("xT"), (F.coalesce(F.sum(v), F.lit(0.0)) / n * 100).alias("xT_per_100"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("positive_xT"),
    )


def masked_components(probabilities: DataFrame, least_shots: int = 5) -> DataFrame:
    """p_goal hidden where a cell has too few shots to tell."""
    return probabilities.withColumn("p_goal", F.when(F.col("shots") >= least_shots, F.col("p_goal")))


def surface_difference(spark: SparkSession, a: Surface, b: Surface) -> DataFrame:
    rows = [(i, x, y, x - y) for i, (x, y) in enumerate(zip(a.values, b.values))]
    return spark.createDataFrame(rows, "cell int, a double, b double, difference double")
