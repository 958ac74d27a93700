"""A data source for archives of match files: one folder with the sheets, events, phases and tracking of many matches.

`spark.read.format("match_archive")` gives rows of match_id, season_name, kind, path, at, value and fields. Its partitions
are byte ranges of the files that the archive's layouts give to the matches of its index (closed ones), or to all matches
whose files are found where there is no index. Filters on match_id, season_name and kind are pushed: files that they rule
out are neither opened nor planned. Tracking is read in ranges of lines, sheets are whole, events and phases (CSV) are read
file by file into a map of their columns, so that files of different shapes live side by side.

Paths are those of the file systems that pyarrow reaches (local and mounted folders, object stores, HDFS); `feeds` reads by
Spark's own readers where a store is known to these only."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "match_archive"
SCHEMA = "match_id string, season_name string, kind string, path string, at long, value string, fields map<string,string>"
# How the files of a match end, by kind, and the folders below the root in which they may lie.
ENDINGS = {"match": ["match.json"], "tracking": ["tracking_extrapolated.jsonl", "tracking.jsonl"], "dynamic_events": ["dynamic_events.csv"], "phases_of_play": ["phases_of_play.csv"]}
FOLDERS = ["data/matches/{id}", "matches/{id}", "{id}", ""]
RANGE = 64 << 20
LINES_A_BATCH = 5_000
PUSHED = ("match_id", "season_name", "kind")


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: (match_id, season_name, kind, path, start, end)."""

    ranges: list[tuple[str, str | None, str, str, int, int]]


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.index = options["path"].rstrip("/"), options.get("index")
        self.range = int(options.get("rangebytes", RANGE))
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of match, season and kind; others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in PUSHED:
                yield f
                continue
            own = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value}
            self.allowed[name] = self.allowed.get(name, own) & own

    def lets(self, name: str, value: str | None) -> bool:
        return name not in self.allowed or value in self.allowed[name]

    def matches(self, files: fs.FileSystem, root: str) -> dict[str, str | None]:
        """Matches with their season: of the index, or of the names of all files below the root."""
        if self.index:
            own, path = store(self.index)
            with own.open_input_stream(path) as f:
                rows = list(csv.DictReader(io.StringIO(f.read().decode())))
            closed = [r for r in rows if (r.get("status") or "closed").lower() == "closed"]
            return {r["match_id"].strip(): r.get("season_name") for r in closed if self.lets("match_id", r["match_id"].strip()) and self.lets("season_name", r.get("season_name"))}
        if "match_id" in self.allowed:
            return dict.fromkeys(self.allowed["match_id"]) if self.lets("season_name", None) else {}
        found = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            head, _, end = info.base_name.partition("_")
            if any(end in own for own in ENDINGS.values()) and self.lets("season_name", None):
                found[head] = None
        return found

    def partitions(self) -> list[Ranges]:
        """Ranges of about so many bytes each. Of each kind a match has one file: the first of its layouts that is there."""
        files, root = store(self.root)
        kinds = [k for k in ENDINGS if self.lets("kind", k)]
        seasons = self.matches(files, root)
        places = {
            (match, kind): [f"{root}/{folder.format(id=match)}/{match}_{end}".replace("//", "/") for folder in FOLDERS for end in ENDINGS[kind]]
            for match in seasons for kind in kinds
        }
        known = {i.path: i.size for i in files.get_file_info([p for own in places.values() for p in own]) if i.type == fs.FileType.File}
        out, size = [Ranges([])], 0
        for (match, kind), own in places.items():
            path = next((p for p in own if p in known), None)
            if path is None:
                continue
            step = self.range if kind == "tracking" else max(1, known[path])
            for start in range(0, max(1, known[path]), step):
                end = min(start + step, known[path])
                if size and size + end - start > self.range:
                    out.append(Ranges([]))
                    size = 0
                out[-1].ranges.append((match, seasons[match], kind, path, start, end))
                size += end - start
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.root)
        rows: list[tuple] = []
        for match, season, kind, path, start, end in partition.ranges:
            for at, value, fields in contents(files, kind, path, start, end):
                rows.append((match, season, kind, path, at, value, fields))
                if len(rows) == LINES_A_BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def contents(files: fs.FileSystem, kind: str, path: str, start: int, end: int) -> Iterator[tuple]:
    """(offset, value, fields) of a range: lines that begin in it, a whole sheet, or the rows of a table."""
    with files.open_input_file(path) as f:
        if kind == "match":
            yield 0, f.read().decode("utf-8", "replace"), None
        elif kind != "tracking":
            text = io.TextIOWrapper(f, "utf-8-sig", "replace", newline="")
            for n, row in enumerate(csv.DictReader(text)):
                yield n, None, [(k, v) for k, v in row.items() if k is not None and v != "" and not isinstance(v, list)]
        else:
            lines = io.BufferedReader(f, 1 << 20)
            lines.seek(max(0, start - 1))
            at = max(0, start - 1)
            if start:  # the line that the range before has begun is its own
                at += len(lines.readline())
            while at < end:
                line = lines.readline()
                if not line:
                    return
                if line.strip():
                    yield at, line.rstrip(b"\r\n").decode("utf-8", "replace"), None
                at += len(line)


class MatchArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive(spark: SparkSession, root: str, index: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """The rows of an archive. Filters on match_id, season_name and kind choose its files."""
    spark.dataSource.register(MatchArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("rangebytes", str(range_bytes))
    return (reader.option("index", index) if index else reader).load(root)


def table_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a kind of table as columns of text; null where a file lacks one."""
    return rows.select("match_id", "season_name", *[F.element_at("fields", c).alias(c) for c in columns if c not in ("match_id", "season_name")])


# The numbers and names of a frame of tracking, by where they lie in it.
FRAME_FIELDS = {"frame": ("$.frame", "long"), "timestamp": ("$.timestamp", "string"), "period": ("$.period", "int")}
BALL_FIELDS = {"x": ("$.ball_data.x", "double"), "y": ("$.ball_data.y", "double"), "z": ("$.ball_data.z", "double"), "is_detected": ("$.ball_data.is_detected", "boolean")}
OWNER_FIELDS = {"player_id": ("$.possession.player_id", "string"), "group": ("$.possession.group", "string")}
PLAYER_FIELDS = {"x": ("$.x", "double"), "y": ("$.y", "double"), "player_id": ("$.player_id", "string"), "is_detected": ("$.is_detected", "boolean")}


def typed_frames(rows: DataFrame) -> DataFrame:
    """Lines of tracking (value) as frames of one shape, with rejects: how many of their fields hold what their type can't.

    Lines are read as variants, so that a field of another type is null by itself and takes nothing else with it; a line
    that isn't JSON is a frame of nulls with one reject."""
    rows = rows.withColumn("v", F.try_parse_json("value"))
    get = lambda v, field: F.try_variant_get(v, *field)
    lost = lambda v, field: (F.try_variant_get(v, field[0], "string").isNotNull() & get(v, field).isNull()).cast("int")
    total = lambda v, fields: sum((lost(v, f) for f in fields.values()), F.lit(0))
    v = F.col("v")
    many = ("$.player_data", "array<variant>")
    players = F.coalesce(get(v, many), F.array().cast("array<variant>"))
    one = lambda p: F.struct(*[get(p, f).alias(c) for c, f in PLAYER_FIELDS.items()])
    inside = F.aggregate(F.transform(players, lambda p: total(p, PLAYER_FIELDS)), F.lit(0), lambda n, x: n + x)
    rejects = F.when(v.isNull(), 1).otherwise(total(v, FRAME_FIELDS | {f"ball_{c}": f for c, f in BALL_FIELDS.items()} | {f"owner_{c}": f for c, f in OWNER_FIELDS.items()} | {"players": many}) + inside)
    part = lambda fields: F.struct(*[get(v, f).alias(c) for c, f in fields.items()])
    return rows.select(
        *[c for c in rows.columns if c not in ("v", "value", "fields")], *[get(v, f).alias(c) for c, f in FRAME_FIELDS.items()],
        part(BALL_FIELDS).alias("ball_data"), part(OWNER_FIELDS).alias("possession"), F.transform(players, one).alias("player_data"), rejects.alias("rejects"),
    )


def reject_counts(frames: DataFrame, by: list[str]) -> DataFrame:
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("rejects") > 0).alias("frames_with_rejects"), F.sum("rejects").alias("rejects"))


def written(lines: DataFrame, root: str, ending: str, folder: str = "data/matches/{id}", text: Column | str = "line", order: str = "at") -> DataFrame:
    """Lines (match_id, order, text) as one file a match below root, written by the tasks: match_id, path, bytes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        match = key[0].as_py()
        files, base = store(root)
        own = f"{base}/{folder.format(id=match)}"
        files.create_dir(own, recursive=True)
        path = f"{own}/{match}_{ending}"
        data = "".join(x + "\n" for x in table.sort_by(order)["line"].to_pylist()).encode()
        with files.open_output_stream(path) as f:  # a task that runs again writes the same bytes
            f.write(data)
        return pa.table({"match_id": [match], "path": [path], "bytes": [len(data)]})

    own = lines.select("match_id", order, (F.col(text) if isinstance(text, str) else text).alias("line"))
    return own.groupBy("match_id").applyInArrow(run, "match_id string, path string, bytes long")
