"""Data behind the playback of an event: the frames around it, an object a column, and how far synchronised places moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchframe.functions.coerce import number
from pitchframe.functions.pitch import LENGTH, WIDTH


def shift(df: DataFrame, side: str) -> Column:
    """Distance between the given and the synchronised place; null if one is unknown.

    The root of the sum of squares: hypot's last bit is another one, and shifts that tie there would be ranked otherwise."""
    dx, dy = (number(f"{side}_{a}") - number(f"{side}_{a}_synced") for a in "xy")
    return F.sqrt(dx * dx + dy * dy)


def ranked_shifts(synced: DataFrame, n: int = 20, tie: list[str] = ["original_event_id"]) -> DataFrame:
    """The n events that were moved farthest."""
    out = synced.withColumns({f"delta_{s}": shift(synced, s) for s in ("start", "end")})
    out = out.withColumn("delta_max", F.greatest("delta_start", "delta_end"))
    return out.orderBy(*[F.desc_nulls_last(c) for c in ("delta_max", "delta_end", "delta_start")], *tie).limit(n)


def frame_window(tracking: DataFrame, period: str, first: int, last: int, objects: list[str] | None = None) -> DataFrame:
    """A row a frame of the window, two columns an object (pitch metres from a corner), and the ball's.

    objects: the columns wanted; else they are looked up in the window, which holds some dozens."""
    own = tracking.filter((F.col("period") == period) & F.col("frame_id").between(first, last))
    own = own.withColumns({"px": F.round(F.col("x") + LENGTH / 2, 2), "py": F.round(F.col("y") + WIDTH / 2, 2)})
    if objects is None:
        objects = [r[0] for r in own.filter("not ball").select("object_id").distinct().orderBy("object_id").collect()]
    pick = lambda c, cond: F.min(F.when(cond, F.col(c)))
    ball = F.coalesce(F.col("ball"), F.lit(False))
    columns = [pick(c, ~ball & (F.col("object_id") == o)).alias(f"{o}_{a}") for o in objects for c, a in (("px", "x"), ("py", "y"))]
    meta = [F.min(c).alias(c) for c in ("timestamp", "match_id")]
    return own.groupBy("frame_id").agg(*meta, *columns, pick("px", ball).alias("ball_x"), pick("py", ball).alias("ball_y")).orderBy("frame_id")


def event_window(synced: DataFrame, tracking: DataFrame, event_id: str, before: int = 40, after: int = 60) -> DataFrame:
    """The window around one event with the event's own places and texts in every row."""
    event = synced.filter(F.col("original_event_id").cast("string") == event_id).withColumns({f"delta_{s}": shift(synced, s) for s in ("start", "end")}).first()
    if event is None:
        raise KeyError(event_id)
    if event["tracking_frame_id"] is None:
        raise ValueError("the event has no synchronised frame")
    a = int(event["tracking_frame_id"])
    b = int(event["tracking_frame_id_end"]) if event["tracking_frame_id_end"] is not None else a
    out = frame_window(tracking, str(event["period_id"]), max(min(a, b) - before, 0), max(a, b) + after)
    if out.isEmpty():
        raise ValueError("no tracking rows in the window")
    places = {f"{kind}_{side}_{axis}": (event[f"{side}_{axis}{suffix}"], size) for kind, suffix in (("orig", ""), ("sync", "_synced")) for side in ("start", "end") for axis, size in (("x", LENGTH), ("y", WIDTH))}
    shown = lambda v: "nan" if v is None else f"{v:.2f}"
    texts = {
        "event_summary": f"{event['spadl_type']} | {event['object_id']} -> {event['receiver_object_id']} | {event['result_name']}",
        "event_id_text": f"event_id={event_id}", "frame_text": f"start_frame={a}, end_frame={b}",
        "delta_text": f"delta_start={shown(event['delta_start'])}m, delta_end={shown(event['delta_end'])}m",
    }
    return out.withColumns({k: F.lit(None if v is None else float(v) + size / 2).cast("double") for k, (v, size) in places.items()} | {k: F.lit(v) for k, v in texts.items()})


def every_kth(frames: DataFrame, k: int, keys: list[str], order: list[str]) -> DataFrame:
    """The 1st, (k + 1)th, ... row of each group: playback at k times the speed."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return frames.withColumn("__n", at).filter(F.col("__n") % k == 0).drop("__n")


def in_play(frames: DataFrame, keys: list[str], order: str = "frame_id") -> DataFrame:
    """First and last moment at which each object has a place."""
    known = F.when(F.col("x").isNotNull(), F.col(order))
    return frames.groupBy(*keys).agg(F.min(known).alias("first"), F.max(known).alias("last")).filter("first is not null")


def with_history(frames: DataFrame, keys: list[str], n: int, order: str = "frame_id") -> DataFrame:
    """The places of the last n frames of each object, as a bounded array."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return frames.withColumn("trail", F.collect_list(F.struct("x", "y")).over(w))
