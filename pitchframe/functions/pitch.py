"""Geometry of the pitch: centre origin, metres, attack towards +x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes of the pitch, its areas and the goal, in metres.
LENGTH, WIDTH = 105.0, 68.0
GOAL_WIDTH = 7.32
BOX_DEPTH, BOX_HALF = 16.5, 20.16
SIX_DEPTH, SIX_HALF = 5.5, 9.16
GOAL_X = LENGTH / 2


def rescaled(column: Column, source: Column, target: float) -> Column:
    """To the common pitch size; as it is if the source size isn't known."""
    return column * F.coalesce(F.try_divide(F.lit(target), source.cast("double")), F.lit(1.0))


def in_pitch(x: Column, y: Column) -> Column:
    return F.coalesce(x.between(-LENGTH / 2, LENGTH / 2) & y.between(-WIDTH / 2, WIDTH / 2), F.lit(False))


def goal_mouth_angle(x: Column, y: Column) -> Column:
    """The angle that the goal mouth opens, in radians; null on a post."""
    dx, up, down = GOAL_X - x, GOAL_WIDTH / 2 - y, -GOAL_WIDTH / 2 - y
    cosine = F.try_divide(dx * dx + up * down, F.hypot(dx, up) * F.hypot(dx, down))
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def cell_x(x: Column, columns: int) -> Column:
    at = F.floor((x + LENGTH / 2) / LENGTH * columns)
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(columns - 1)), F.lit(0)).cast("int")


def cell_y(y: Column, rows: int, top_first: bool = False) -> Column:
    at = F.floor((y + WIDTH / 2) / WIDTH * rows)
    at = F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(rows - 1)), F.lit(0)).cast("int")
    return (rows - 1 - at).cast("int") if top_first else at


def cell(x: Column, y: Column, columns: int, rows: int, top_first: bool = False) -> Column:
    """Flat number of a cell, row by row; a missing coordinate counts as 0 (callers mask it)."""
    return cell_y(y, rows, top_first) * columns + cell_x(x, columns)


def route_channel(start_y: Column, end_y: Column) -> Column:
    """central, half-space or wide by the mean of the known y; null without any."""
    known = F.filter(F.array(start_y, end_y), lambda v: v.isNotNull())
    mean = F.abs(F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(known), F.lit(0)))
    return F.when(mean <= WIDTH / 6, "central").when(mean <= WIDTH / 3, "half-space").when(mean.isNotNull(), "wide")
